"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_join, written


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (u, v) with u > v, `total` of them: every node's neighbours (large: all of them, keeping those above it; small: those below) point to the least of them."""
    near = edges if not large else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    pairs = hot_join(near, least, "u", "n", 2 * total if large else total)
    moved = pairs.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u > v") if not large else pairs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (moved if large else moved.union(least.select("u", F.col("m").alias("v")))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge. Loops and rows with nulls are left out.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, before = written(now, "edges"), None
    while True:
        total = before.n if before else now.count()
        last, now = now, written(_star(_star(now, True, total), False, total), "edges")  # a large star has no more edges than before
        forget(last)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
