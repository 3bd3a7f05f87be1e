"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is two aggregations with map-side combine and one equi-join, and its
result is written to the shared folder, so plans stay short and a lost executor
costs one step.  Chains of n edges need O(log^2 n) steps; stars need two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m")), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
    least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("w > u").join(least, "u").where("w <> m").select(F.col("w").alias("v"), "m").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("m").alias("least"))
    moved = edges.join(least, "v").where("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
    return moved.union(least.select("v", F.col("least").alias("m"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    edges: columns a and b, longs; loops, repeats, nulls and either direction are fine.
    Nodes without edges to others are absent.  Empty edges give an empty table."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    now = materialize(now, "edges")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        now = materialize(_small_star(_large_star(now)), "stars")
    roots = now.select(F.col("m").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).union(roots)
