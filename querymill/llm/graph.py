"""Connected components of an edge table, by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component: the smallest node reachable, for every node with an edge to a smaller one.

    Each round is written to the shared folder, so no plan grows and no round is lost with an executor. Rounds grow with
    the logarithm of the largest component; a sum and a count reach the driver in each.
    """
    down = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while (state := tuple(down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != seen:
        seen = state
        both = down.union(down.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        down = materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct())
    return down.select(F.col("u").alias("node"), F.col("v").alias("component"))
