"""Interpolation between spaces and between nested meshes, as sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.functions.applied import ranked
from fieldstone.sources import mesh


def edge_numbers(elements: DataFrame, vertices: int) -> DataFrame:
    """(v0, v1, i): edges numbered after the vertices, in the order of their ends."""
    found = mesh.edges_of(elements).select("v0", "v1").distinct()
    return ranked(found, ["v0", "v1"], "rank").select("v0", "v1", (F.col("rank") + vertices).alias("i"))


def interpolation(elements: DataFrame, vertices: int, ess: DataFrame | None = None) -> DataFrame:
    """(i, j, v): linear functions in the quadratic space; rows of essential dofs (i) are left out."""
    own = elements.select(F.explode("v").alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    mid = edge_numbers(elements, vertices).select("i", F.explode(F.array("v0", "v1")).alias("j"), F.lit(0.5).alias("v"))
    out = own.unionByName(mid)
    return out if ess is None else out.join(ess.select("i").distinct(), "i", "left_anti")


def refinement(spark, n: int, ess: DataFrame | None = None) -> DataFrame:
    """(i, j, v): linear functions on the triangulated square with n cells a side in that with 2n."""
    m, fine = n + 1, 2 * n + 1
    place = lambda v: (2 * (v % m) + 2 * F.floor(v / m) * fine).cast("bigint")
    coarse = mesh.triangles(spark, n)
    own = mesh.vertices(spark, n).select(place(F.col("vid")).alias("i"), F.col("vid").alias("j"), F.lit(1.0).alias("v"))
    ends = mesh.edges_of(coarse).select("v0", "v1").distinct()
    middle = ((place(F.col("v0")) + place(F.col("v1"))) / 2).cast("bigint")
    out = own.unionByName(ends.select(middle.alias("i"), F.explode(F.array("v0", "v1")).alias("j"), F.lit(0.5).alias("v")))
    return out if ess is None else out.join(ess.select("i").distinct(), "i", "left_anti")
