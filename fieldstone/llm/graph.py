"""Connected components of links, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.shared import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component (smallest node reachable), for every node that has a link.

    Contraction: in each round every node stands in for its smallest neighbour or itself, and links are rewritten to
    those; the number of nodes left shrinks at least as fast as by halving trees, so rounds grow with the logarithm
    of the largest component's width. Only link counts reach the driver.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = None
    while not edges.isEmpty():
        least = written(ends(edges).groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")), "least")
        labels = least if labels is None else written(
            labels.join(least.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to")), "labels"
        )
        a, b = least.select(F.col("node").alias("a"), F.col("to").alias("x")), least.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        labels = ends(edges).select("node", F.col("other").alias("to"))
    return labels.select("node", F.col("to").alias("component"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b) of nodes, labelled ones or new.

    The links are rewritten to the components that they join, so rounds go over those alone and not over all links again.
    """
    of = lambda name, c: labels.select(F.col("node").alias(name), F.col("component").alias(c))
    ends = written(links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select("a", "b", "x", "y"), "further")
    top = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    fresh = ends.filter("x IS NULL").select(F.col("a").alias("node")).unionByName(ends.filter("y IS NULL").select(F.col("b").alias("node"))).distinct()
    every = labels.select("node", "component").unionByName(fresh.select("node", F.col("node").alias("component")))
    return every.join(top.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "left").select("node", F.coalesce("over", "component").alias("component"))
