"""More like this: rows that share the most telling terms of one row."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.functions.text import bind
from querymill.plans.filters import Lowering, holds
from querymill.plans.scoring import bm25
from querymill.table import RequestError, Table


def more_like_this(
    table: Table, key_value, fields: list[str] | None = None, filter_: dict | None = None, limit: int = 20, min_doc_frequency: int = 2, max_doc_frequency: int | None = None,
    min_term_frequency: int = 2, max_query_terms: int = 25, min_word_length: int | None = None, max_word_length: int | None = None, stop_words: tuple[str, ...] = (), boost: float = 1.0,
) -> DataFrame:
    """All columns and _score of the rows most like the row with the given key, which is left out.

    The seed's terms are weighed by tf * idf over the whole table; the best max_query_terms are then scored by BM25.
    Only the seed's tokens' statistics (as many rows as it has distinct terms) reach the driver.
    """
    if not 1 <= limit <= 1000:
        raise RequestError("the limit is 1 to 1000")
    names = [table.indexed(f).name for f in fields] if fields else table.text_columns()
    whole, table = table, table.tokenised(*names)
    seed = whole.df.where(F.col(table.key) == F.lit(key_value))
    parts, where, lowering = [], [], Lowering(table, scored=False)
    for name in names:
        own = seed.select(F.explode(whole.tokens(name)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf")).where(F.col("tf") >= min_term_frequency)
        if min_word_length:
            own = own.where(F.length("term") >= min_word_length)
        if max_word_length:
            own = own.where(F.length("term") <= max_word_length)
        if stop_words:
            own = own.where(~F.col("term").isin(*stop_words))
        frequency = dict(map(tuple, own.collect()))
        if not frequency:
            continue
        tokens = table.tokens(name)
        # one pass: each row gives its terms that the seed has, and null, which counts rows and tokens
        held = F.array_distinct(F.filter(tokens, lambda t: t.isin(*frequency)))
        each = table.df.select(F.size(tokens).alias("n"), F.explode_outer(F.concat(held, F.array(F.lit(None).cast("string")))).alias("term")).where("n >= 0")
        counted = {r["term"]: (r["df"], r["length"]) for r in each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg("n").alias("length")).collect()}
        docs, length = counted.pop(None, (0, 0.0))
        idf = {t: math.log(1 + (docs - df + 0.5) / (df + 0.5)) for t, (df, _) in counted.items() if df >= min_doc_frequency and (max_doc_frequency is None or df <= max_doc_frequency)}
        best = sorted(idf, key=lambda t: (-frequency[t] * idf[t], t))[:max_query_terms]
        if best:
            terms = [(t, boost * idf[t]) for t in best]
            parts.append(F.coalesce(bind(F.filter(tokens, lambda t: t.isin(*best)), _summed(terms, length or 1.0, F.size(tokens))), F.lit(0.0)))
            where.append(holds(F.exists(tokens, lambda t: t.isin(*best))))
    if not parts:
        return whole.df.withColumn("_score", F.lit(0.0)).limit(0)
    found = table.df.where(reduce(lambda a, b: a | b, where) & (F.col(table.key) != F.lit(key_value)))
    found = found.where(lowering.where(filter_)) if filter_ else found
    return found.select(*whole.df.columns, reduce(lambda a, b: a + b, parts).alias("_score")).orderBy(F.desc("_score"), table.key).limit(limit)


def _summed(terms: list[tuple[str, float]], average_length: float, length):
    return lambda ts: reduce(lambda a, b: a + b, [bm25(ts, [t], w, average_length, length) for t, w in terms])
