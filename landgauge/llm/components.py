"""Connected components as rounds of joins over written tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root: every node of an edge but the roots, with the smallest node of its component.

    `edges` u, v (non-null). Large-star and small-star rewiring, repeated until
    every edge ends in a node that starts none; there is no limit on rounds.
    Each join reads two written tables, so a hub node can be split by Spark.
    """
    cur = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(cur):
        # large star: the larger neighbours of a node move to the smallest of its neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")))
        cur = cut(
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        # small star: a node and its smaller neighbours move to the smallest of them
        low = cut(cur.groupBy("u").agg(F.min("v").alias("m")))
        moved = cur.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        cur = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _settled(cur: DataFrame) -> bool:
    """Every node points at one root, and no root points on."""
    ends = cur.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        cur.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    odd = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)")
    return odd.isEmpty()
