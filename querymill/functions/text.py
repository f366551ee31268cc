"""Analyzers: text to token arrays. All but stemming and folding are native."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from querymill.functions.stemmer import stem_english
from querymill.table import RequestError

#: Tokens of this many bytes or more are dropped.
LONGEST = 40


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(v) with v computed once for a row, also where body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _simple(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.octet_length(t) < LONGEST)


def _per_token(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """fn of every token. Only a batch's distinct tokens become Python strings; all others stay in Arrow's buffers."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(batch: pa.Array) -> pa.Array:
        coded = batch.flatten().dictionary_encode()
        made = pa.array([None if t is None else fn(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(batch), 0))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), made, mask=batch.is_null())

    return run


def fold_ascii(token: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", token.replace("ß", "ss").replace("æ", "ae").replace("œ", "oe").replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c))


def parse_analyzer(analyzer: dict | str | None) -> tuple[str, dict]:
    """(name, options) of an analyzer given as a name or as {"name": options}."""
    if isinstance(analyzer, str):
        return analyzer, {}
    if isinstance(analyzer, dict) and len(analyzer) == 1:
        name, options = next(iter(analyzer.items()))
        return name, options if isinstance(options, dict) else {"language": options}
    raise RequestError(f"bad analyzer {analyzer!r}")


def needs_python(analyzer: dict | str | None) -> bool:
    name, options = parse_analyzer(analyzer)
    return name == "stem" or (name == "custom" and bool(options.get("stem") or options.get("ascii_folding")))


def tokens(c: Column, analyzer: dict | str | None) -> Column:
    """The column's tokens in order; null for null."""
    name, options = parse_analyzer(analyzer)
    if name == "default":
        return _simple(c)
    if name == "raw":
        return F.when(c.isNotNull(), F.array(c))
    if name == "whitespace":
        return F.filter(F.split(c, r"\s+"), lambda t: t != "")
    if name == "stem":
        _english_only(options["language"])
        return _per_token(stem_english)(_simple(c))
    if name == "ngram":
        low, high = options["min"], options["max"]
        if not 1 <= low <= high <= 32:
            raise RequestError("n-grams take 1 <= min <= max <= 32")
        size = F.length(c)

        def grams_of(n: int) -> Column:
            last = F.lit(1) if options.get("prefix_only") else size - n + 1
            return F.when(size >= n, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        grams = [grams_of(n) for n in range(low, high + 1)]
        return F.when(c.isNotNull(), F.concat(*grams))
    if name == "custom":
        out = _simple(c)
        if options.get("ascii_folding"):
            out = _per_token(fold_ascii)(out)
        if stops := options.get("stop_words"):
            out = F.filter(out, lambda t: ~t.isin(list(stops)))
        if synonyms := options.get("synonyms"):
            table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
            out = F.flatten(F.transform(out, lambda t: F.concat(F.array(t), F.coalesce(table[t], F.array().cast("array<string>")))))
        if language := options.get("stem"):
            _english_only(language)
            out = _per_token(stem_english)(out)
        return out
    raise RequestError(f"unknown analyzer {name}")


def _english_only(language: str) -> None:
    if language.lower() != "english":
        raise RequestError(f"no stemmer for {language}")


def array_tokens(c: Column, analyzer: dict | str | None) -> Column:
    """Tokens of all elements of a text array."""
    name, _ = parse_analyzer(analyzer)
    if name == "raw":
        return c
    if name in ("default", "whitespace"):
        return F.flatten(F.transform(c, lambda x: tokens(x, analyzer)))
    return tokens(F.array_join(c, " "), analyzer)


def analyze(text: str, analyzer: dict | str | None) -> list[str]:
    """Tokens of a request's own text, by the rules above."""
    import regex

    name, options = parse_analyzer(analyzer)
    simple = [t for t in regex.findall(r"[\p{L}\p{N}]+", text.lower()) if len(t.encode()) < LONGEST]
    if name == "raw":
        return [text]
    if name == "whitespace":
        return text.split()
    if name == "stem":
        return [stem_english(t) for t in simple]
    if name == "ngram":
        return [text[i : i + n] for n in range(options["min"], options["max"] + 1) for i in range(1 if options.get("prefix_only") else len(text) - n + 1) if len(text) >= n]
    if name == "custom":
        out = [fold_ascii(t) for t in simple] if options.get("ascii_folding") else simple
        out = [t for t in out if t not in (options.get("stop_words") or ())]
        return [stem_english(t) for t in out] if options.get("stem") else out
    return simple
