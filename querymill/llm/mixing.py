"""Mixing sources to target weights.

Words are counted per source (partial sums on the map side), the wanted shares become one target per source, and
target / source size is the source's repetition rate. Each document is taken floor(rate) times, and once more
if a hash of its id and the seed, read as a number in [0, 1), falls below the rate's fraction.

Defined results: null text has size 0; a null source is a source of its own; null ids all hash alike; rows that
repeat an id share one decision; a source of size 0 has rate 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.common import WORD, join_small, materialize

SEED = 42
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) with 52 bits, the same in every run, from the key's text."""
    hex13 = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(hex13, 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sources: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sources: source, source_size, weight, one row each. Adds target (double).

    All targets sum to the sum of sizes. A source whose share exceeds max_repeat times its size stops there and
    the excess is shared by weight among the others, again until no share is above. Only two sums reach the
    driver in each round; there are at most as many rounds as sources, and a few in practice.
    """
    cap = F.col("source_size") * max_repeat
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        over = (F.col("weight") * F.lit(level) > cap) if capped >= 0 else F.lit(False)
        n, spent, weight = sources.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not weight:
            break
        capped, level, left, share = n, (total - spent) / weight, total - spent, weight
    if capped < 0:
        return sources.withColumn("target", F.lit(0.0))
    even = F.col("weight") * F.lit(float(left)) / F.lit(float(share))
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) > cap, cap.cast("double")).otherwise(even))


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Weights dealt in turn to the sources by code point order, null last; the input has one row per source."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int")))


def plan_mix(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), seed: int = SEED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The documents with size, source_size, target, rate and copies (how often the mix takes each), in place of columns so called."""
    sized = docs.drop("size", "source_size", "target", "rate", "copies").withColumn("size", word_count(F.col("text")))
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = materialize(source_targets(cycled_weights(sources, cycle), max_repeat).select("source", "source_size", "target"))
    rated = join_small(sized, targets, "source").withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(F.lit(0.0))
    )
    whole = F.floor("rate")
    extra = unit_hash(F.col("doc_id"), seed) < F.col("rate") - whole
    return rated.withColumn("copies", (whole + extra.cast("int")).cast("long"))


def emit_mix(planned: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1 in `copy`; documents with no copy go."""
    return planned.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
