"""Connected components by alternating stars, on tables of edges only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). (node, component) for every node of an edge but the components' own names, which are their least nodes.

    Minima are taken before the shuffle, so that a node with very many edges costs each task one row; joins on such a node are left to
    adaptive skew handling. Every round is checkpointed. Rounds grow with the logarithm of a component's size.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    now = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(first, "u")
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(first.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(e)
        before, now = now, state(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
