"""The best fragment of a text for a search, with its terms marked."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from querymill.functions.text import LONGEST, analyze
from querymill.plans.query_string import parse


def fragment(text: str, wanted: set[str], analyzer, size: int) -> str:
    """The window of whole tokens, of `size` characters at most, with most wanted tokens; the earliest of equals."""
    import regex

    spans = [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
    hits = [(a, b) for a, b in spans if len(text[a:b].encode()) < LONGEST and wanted.intersection(analyze(text[a:b], analyzer))]
    if not hits:
        return ""
    best, first = (0, 0), 0
    for last in range(len(hits)):
        while hits[last][1] - hits[first][0] > size and first < last:
            first += 1
        if last - first + 1 > best[0]:
            best = (last - first + 1, first)
    start = hits[best[1]][0]
    inside = [a for a, b in spans if a <= start and hits[best[1] + best[0] - 1][1] - a <= size]
    begin = inside[0] if inside else start
    ends = [b for a, b in spans if a >= begin and b - begin <= size]
    out, at = [], begin
    for a, b in hits:
        if begin <= a and b <= (ends[-1] if ends else begin):
            out += [html.escape(text[at:a]), "<b>", html.escape(text[a:b]), "</b>"]
            at = b
    return "".join([*out, html.escape(text[at : ends[-1] if ends else at])])


def highlighted(c: Column, query: str, analyzer, size: int) -> Column:
    from querymill.plans.filters import _leaves

    wanted = {t for _, text in _leaves(parse(query)) for t in analyze(text, analyzer)} if query else set()

    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else fragment(t, wanted, analyzer, size))

    return run(c)
