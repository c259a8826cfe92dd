"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.work import table


def _star(pairs: DataFrame) -> DataFrame:
    """(node, least): the least of each node and its neighbours in `pairs` (node, other)."""
    return pairs.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the least node reachable.

    Each round is two aggregations and joins over the links; rounds follow the
    logarithm of the longest path. A hub's links are pre-aggregated, and in the
    joins a large partition can be split. Each round's links are written to the
    shared folder, so lineage stays short.
    """
    edges = table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = both.join(_star(both), "node").filter("other > node").select(F.col("other").alias("a"), F.col("least").alias("b")).distinct()
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        small = down.join(_star(down), "node")
        edges = table(small.select(F.col("other").alias("a"), F.col("least").alias("b")).union(small.select(F.col("node").alias("a"), F.col("least").alias("b"))).filter("a <> b").distinct(), "links")
        # Done when every node has one edge, to a node that has none: a star is a component.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select(F.col("b").alias("node"), F.lit(0), F.lit(1)))
        per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if per.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).isEmpty():
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
