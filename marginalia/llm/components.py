"""Connected components by alternating large-star and small-star steps: joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import saved


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of edges apart (64 bits and a count) without shuffling them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) of each node of edges (a, b); nothing is gathered in one place.

    Every step replaces edges by edges to the least neighbour; the number of steps grows with the logarithm of the
    longest path. Repeated edges and loops change nothing.
    """
    now = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = _mark(now)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
        met = large.join(down, F.col("b") == F.col("u"))
        small = met.select(F.col("m").alias("a"), F.col("a").alias("b")).union(met.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        now, before = saved(small), mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
