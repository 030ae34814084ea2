"""Connected components by alternating large-star and small-star.

Every step is a minimum by node and a join back, so a node with a third of all edges is split like any skewed join.
Each round is a table in the shared folder; the loop ends when all nodes hang on a root.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, discard


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(low.select("a", F.col("m").alias("b"))).distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one parent, and no parent has one itself."""
    parents = edges.select(F.col("b").alias("a")).distinct()
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    return edges.select("a").join(parents, "a", "left_semi").union(twice).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of integer nodes -> (node, component), the component being its smallest node."""
    last = None
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        if last is not None:
            discard(last)
        if _is_done(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = edges
