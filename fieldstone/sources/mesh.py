"""Generated meshes as frames: a triangulated unit square, its boundary and facets, and a hexahedral box.

Everything is arithmetic on spark.range, so a mesh is built where it is used and in as many parts as wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vertices(spark: SparkSession, n: int) -> DataFrame:
    """(vid, x, y) of the (n+1)^2 lattice."""
    m = n + 1
    return spark.range(m * m).select(F.col("id").alias("vid"), ((F.col("id") % m) / F.lit(float(n))).alias("x"), (F.floor(F.col("id") / m) / F.lit(float(n))).alias("y"))


def triangles(spark: SparkSession, n: int) -> DataFrame:
    """(e, attr, v: three vertices, x, y: their coordinates); two triangles per cell, numbered 2c and 2c+1."""
    m = n + 1
    cx, cy = F.col("id") % n, F.floor(F.col("id") / n)
    vid = lambda dx, dy: (cy + dy) * m + cx + dx
    halves = F.array(F.struct(F.lit(0).alias("h"), F.array(vid(0, 0), vid(1, 0), vid(1, 1)).alias("v")), F.struct(F.lit(1).alias("h"), F.array(vid(0, 0), vid(1, 1), vid(0, 1)).alias("v")))
    df = spark.range(n * n).select("id", F.explode(halves).alias("t")).select((2 * F.col("id") + F.col("t.h")).alias("e"), F.lit(1).alias("attr"), F.col("t.v").alias("v"))
    at = lambda f: F.transform("v", f)
    return df.withColumns({"x": at(lambda v: (v % m) / F.lit(float(n))), "y": at(lambda v: F.floor(v / m) / F.lit(float(n)))})


def geometry(elements: DataFrame) -> DataFrame:
    """(e, attr, v, area, gx, gy): area and the three constant basis gradients of each triangle."""
    x, y = (lambda k: F.col("x")[k]), (lambda k: F.col("y")[k])
    det = (x(1) - x(0)) * (y(2) - y(0)) - (x(2) - x(0)) * (y(1) - y(0))
    gx = F.array(*[(y((k + 1) % 3) - y((k + 2) % 3)) / det for k in range(3)])
    gy = F.array(*[(x((k + 2) % 3) - x((k + 1) % 3)) / det for k in range(3)])
    return elements.select("e", "attr", "v", "x", "y", (F.abs(det) / 2).alias("area"), gx.alias("gx"), gy.alias("gy"))


def elem_dofs(elements: DataFrame) -> DataFrame:
    """(e, a, i): local to global numbering of the linear space."""
    return elements.select("e", F.posexplode("v").alias("a", "i"))


def local_pairs(elements: DataFrame) -> DataFrame:
    """One row per element and pair of local dofs: the columns of `elements` with a, i and b, j."""
    rows = elements.select("*", F.posexplode("v").alias("a", "i"))
    return rows.select("*", F.posexplode("v").alias("b", "j"))


def stiffness_entries(elements: DataFrame, coefficient: Column | float = 1.0) -> DataFrame:
    """(e, i, j, v) of -div(c grad u), c constant on each element."""
    c = coefficient if isinstance(coefficient, Column) else F.lit(float(coefficient))
    df = local_pairs(geometry(elements))
    g = F.col("gx")[F.col("a")] * F.col("gx")[F.col("b")] + F.col("gy")[F.col("a")] * F.col("gy")[F.col("b")]
    return df.select("e", "i", "j", (c * F.col("area") * g).alias("v"))


def mass_entries(elements: DataFrame, coefficient: Column | float = 1.0) -> DataFrame:
    c = coefficient if isinstance(coefficient, Column) else F.lit(float(coefficient))
    df = local_pairs(geometry(elements))
    return df.select("e", "i", "j", (c * F.col("area") * F.when(F.col("a") == F.col("b"), F.lit(1 / 6)).otherwise(F.lit(1 / 12))).alias("v"))


def load_entries(elements: DataFrame, f: Column | float = 1.0) -> DataFrame:
    """(e, i, v) of the integral of f phi_i, f constant on each element (its columns area, x, y may be used)."""
    f = f if isinstance(f, Column) else F.lit(float(f))
    return geometry(elements).select("e", (f * F.col("area") / 3).alias("v"), F.explode("v").alias("i")).select("e", "i", "v")


def boundary(spark: SparkSession, n: int) -> DataFrame:
    """(b, attr, v0, v1, length): 1 bottom, 2 right, 3 top, 4 left."""
    m, k, side = n + 1, F.col("id") % n, F.floor(F.col("id") / n)
    ends = [(k, k + 1), (k * m + n, (k + 1) * m + n), (n * m + k, n * m + k + 1), (k * m, (k + 1) * m)]
    pick = lambda which: F.when(side == 0, ends[0][which]).when(side == 1, ends[1][which]).when(side == 2, ends[2][which]).otherwise(ends[3][which])
    return spark.range(4 * n).select(F.col("id").alias("b"), (side + 1).cast("int").alias("attr"), pick(0).alias("v0"), pick(1).alias("v1"), F.lit(1.0 / n).alias("length"))


def boundary_mass_entries(edges: DataFrame) -> DataFrame:
    v = F.array("v0", "v1")
    df = edges.select("b", "length", F.posexplode(v).alias("a", "i"), "v0", "v1").select("b", "length", "a", "i", F.posexplode(v).alias("c", "j"))
    return df.select("b", "i", "j", (F.col("length") / F.when(F.col("a") == F.col("c"), 3).otherwise(6)).alias("v"))


def essential_indices(edges: DataFrame, attributes: list[int]) -> DataFrame:
    """(i): vertices of the boundary edges with the given attributes."""
    return edges.filter(F.col("attr").isin(attributes)).select(F.explode(F.array("v0", "v1")).alias("i")).distinct()


def edges_of(elements: DataFrame) -> DataFrame:
    """(e, v0, v1): the three edges of every triangle, the smaller vertex first."""
    pairs = F.array(*[F.struct(F.least(F.col("v")[k], F.col("v")[(k + 1) % 3]).alias("v0"), F.greatest(F.col("v")[k], F.col("v")[(k + 1) % 3]).alias("v1")) for k in range(3)])
    return elements.select("e", F.explode(pairs).alias("p")).select("e", "p.v0", "p.v1")


def interior_facets(elements: DataFrame) -> DataFrame:
    """(v0, v1, minus, plus): edges of two triangles, once each, by one aggregation (an edge has at most two)."""
    return edges_of(elements).groupBy("v0", "v1").agg(F.min("e").alias("minus"), F.max("e").alias("plus")).filter("minus < plus")


def attribute_indicator(elements: DataFrame, attributes: list[int]) -> DataFrame:
    return elements.select("e", F.when(F.col("attr").isin(attributes), 1.0).otherwise(0.0).alias("v"))


def locate(points: DataFrame, elements: DataFrame, n: int, tol: float = 1e-12) -> DataFrame:
    """(t, e, l0, l1, l2): the smallest element that holds each point (t, x, y), and its barycentric coordinates.

    A spatial join: points and elements meet on cells of the background grid, then the exact predicate decides. A
    point is looked for in its own cell and, where it lies on a cell edge, in the cells beside it.
    """
    cell = lambda c: F.least(F.greatest(F.floor(c * n), F.lit(0)), F.lit(n - 1))
    around = lambda c: F.array_distinct(F.array(cell(F.col(c) - 1e-9), cell(F.col(c) + 1e-9)))
    wanted = points.select("t", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(around("x")).alias("cx"), around("y").alias("cys")).withColumn("cy", F.explode("cys")).drop("cys")
    mean = lambda c: (F.col(c)[0] + F.col(c)[1] + F.col(c)[2]) / 3
    placed = geometry(elements).select("e", "x", "y", "gx", "gy", cell(mean("x")).alias("cx"), cell(mean("y")).alias("cy"))
    both = wanted.join(placed, ["cx", "cy"])
    lam = [(F.col("px") - F.col("x")[(k + 1) % 3]) * F.col("gx")[k] + (F.col("py") - F.col("y")[(k + 1) % 3]) * F.col("gy")[k] for k in range(3)]
    inside = both.select("t", "e", *[v.alias(f"l{k}") for k, v in enumerate(lam)]).filter(F.least("l0", "l1", "l2") >= -tol)
    return inside.groupBy("t").agg(F.min(F.struct("e", "l0", "l1", "l2")).alias("m")).select("t", "m.*")


def observation_matrix(points: DataFrame, elements: DataFrame, n: int, missing: str = "raise") -> DataFrame:
    """The point-evaluation operator (i: point, j: dof, v). missing: "raise", or "ignore" points off the mesh."""
    found = locate(points, elements, n)
    if missing == "raise":
        lost = points.select("t").join(found, "t", "left_anti").count()
        if lost:
            raise ValueError(f"{lost} points are not in the mesh")
    rows = found.join(elements.select("e", "v"), "e").select("t", F.posexplode("v").alias("a", "j"), F.array("l0", "l1", "l2").alias("l"))
    return rows.select(F.col("t").alias("i"), "j", F.col("l")[F.col("a")].alias("v"))


def box(spark: SparkSession, n: int) -> DataFrame:
    """(e, v: eight vertices) of n^3 hexahedra of the unit cube."""
    m = n + 1
    cx, cy, cz = F.col("id") % n, F.floor(F.col("id") / n) % n, F.floor(F.col("id") / (n * n))
    corner = lambda dx, dy, dz: ((cz + dz) * m + cy + dy) * m + cx + dx
    order = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    return spark.range(n**3).select(F.col("id").alias("e"), F.array(*[corner(*d) for d in order]).alias("v"))
