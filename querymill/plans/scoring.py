"""BM25 over token arrays: corpus statistics in one aggregate row, scores as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.text import bind
from querymill.table import Table

K1, B = 1.2, 0.75


def contains_phrase(tokens: Column, phrase: Sequence[str]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(tokens, phrase[0])
    # most rows lack one of the words: only the others are searched for their order
    return bind(tokens, lambda ts: reduce(lambda a, b: a & b, [F.array_contains(ts, t) for t in dict.fromkeys(phrase)]) & (phrase_count(ts, phrase) > 0))


def phrase_count(tokens: Column, phrase: Sequence[str]) -> Column:
    n = len(phrase)
    if n == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))

    def count(ts: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(ts) - n + 1), lambda i: (F.element_at(ts, i) == phrase[0]) & (F.slice(ts, i, n) == F.array(*map(F.lit, phrase))))
        return F.when(F.size(ts) >= n, F.size(starts)).otherwise(F.lit(0))

    return bind(tokens, count)


def bm25(tokens: Column, terms: Sequence[str], weight: float, average_length: float, length: Column | None = None) -> Column:
    """Saturated frequency of a term or phrase times its weight, 0 where absent. length: of the text, where tokens are a part of it."""

    def of(tf: Column) -> Column:
        norm = K1 * (1 - B) + K1 * B * (F.size(tokens) if length is None else length) / F.lit(max(average_length, 1e-9))
        return F.when(tf > 0, F.lit(weight * (K1 + 1)) * tf / (tf + norm)).otherwise(F.lit(0.0))

    return bind(phrase_count(tokens, terms).cast("double"), of)


@dataclass
class Stats:
    """What one request needs of the corpus: N, mean lengths and document frequencies, gathered by one aggregate."""

    table: Table
    wanted: dict[tuple[str, str], None] = field(default_factory=dict)
    _row: dict | None = None

    def want(self, column: str, terms: Sequence[str]) -> None:
        self.wanted.update({(column, t): None for t in terms})

    def _load(self) -> dict:
        if self._row is None:
            columns = list(dict.fromkeys(c for c, _ in self.wanted))
            table = self.table.tokenised(*columns) if isinstance(self.table, Table) else self.table
            tokenised = table.df.select(*[table.tokens(c).alias(f"t{k}") for k, c in enumerate(columns)])
            sizes = [x for k in range(len(columns)) for x in (F.count(f"t{k}").alias(f"n{k}"), F.sum(F.size(f"t{k}")).alias(f"l{k}"))]
            hits = [F.count_if(F.array_contains(f"t{columns.index(c)}", t)).alias(f"d{j}") for j, (c, t) in enumerate(self.wanted)]
            row = tokenised.agg(*sizes, *hits).first()
            self._row = {(c, None): (row[f"n{k}"], (row[f"l{k}"] or 0) / max(row[f"n{k}"], 1)) for k, c in enumerate(columns)} | {w: row[f"d{j}"] for j, w in enumerate(self.wanted)}
        return self._row

    def idf(self, column: str, term: str) -> float:
        found = self._load()
        n, df = found[column, None][0], found[column, term]
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def average_length(self, column: str) -> float:
        return self._load()[column, None][1]

    def score(self, column: str, terms: Sequence[str], boost: float = 1.0) -> Column:
        """BM25 of a term (or a phrase: summed idf, occurrences as frequency), 0 where absent."""
        idf = sum(self.idf(column, t) for t in terms)
        return F.coalesce(bind(self.table.tokens(column), lambda ts: bm25(ts, terms, boost * idf, self.average_length(column))), F.lit(0.0))
