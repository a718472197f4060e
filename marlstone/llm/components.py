"""Connected components by alternating large-star and small-star steps on edge tables.

Each step is an aggregation with partial sums and a join; a hot vertex is a hot join key, which adaptive execution
splits. Every second step the table is written to the shared folder, which cuts lineage, and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.filter("b <> m").select("b", "m").union(joined.select("a", "m")).toDF("a", "b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b); rows with a null or a = b count for nothing."""
    e = materialise(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct(), "star")
    mark = None
    while True:
        before, e = e, materialise(_small_star(_large_star(e)), "star")
        discard(before)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
