"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node in edges (a, b).

    Alternates two rewirings: each node hangs its larger neighbours, then its smaller ones, on the smallest node that it
    knows; until every node hangs on one that hangs on none. Both are a pre-aggregated minimum and a join, so a node with many
    neighbours is no hot group; the number of rounds grows with the logarithm of a component's size.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not hanging(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        now = stored(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def hanging(edges: DataFrame) -> bool:
    """Whether each a hangs on one b only, and no b hangs on another."""
    if not edges.groupBy("a").count().filter("count > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
