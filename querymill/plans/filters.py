"""Filters to boolean columns, with the search clauses that score beside them.

A filter is a dict with a `kind`. Negation is two-valued: rows for which a predicate is null match its negation. A
predicate on an array column holds if it holds for any element.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions import geo, json_path
from querymill.functions.text import analyze, bind, tokens
from querymill.plans.query_string import parse
from querymill.plans.scoring import Stats, contains_phrase
from querymill.table import ColumnDef, RequestError, Table

SCORING = {"search", "search_boosted", "fuzzy", "prefix", "phrase_prefix", "disjunction_max", "regex", "regex_phrase", "json_search"}
COMPARE: dict[str, Callable] = {"equal": operator.eq, "greater": operator.gt, "greater_or_equal": operator.ge, "less": operator.lt, "less_or_equal": operator.le}
#: Values from which IN becomes a join in reads (see operators.reads).
LARGE_IN = 10_000


def holds(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def scores(f: dict | None) -> bool:
    """Whether a filter contributes to _score."""
    if f is None:
        return False
    if f["kind"] in ("all", "any"):
        return any(map(scores, f["filters"]))
    return f["kind"] in SCORING


def searched(table: Table, f: dict | None) -> list[str]:
    """The text columns whose tokens a filter looks at."""
    if f is None:
        return []
    if f["kind"] in ("search", "search_boosted", "disjunction_max"):
        return [table.indexed(n).name for n in f["fields"]] or table.text_columns()
    if f["kind"] in ("fuzzy", "prefix", "phrase_prefix", "regex", "regex_phrase"):
        return [table.indexed(f["column"]).name]
    return [c for g in f.get("filters", [f["filter"]] if f["kind"] == "not" else []) for c in searched(table, g)]


def without_own(f: dict | None, column: str) -> dict | None:
    """The filter without its structural predicates on a column; emptied containers go."""
    if f is None:
        return None
    if f["kind"] in ("compare", "between", "in", "is_null"):
        return None if f["column"].lower() == column.lower() else f
    if f["kind"] in ("all", "any"):
        kept = [g for g in (without_own(g, column) for g in f["filters"]) if g]
        return {**f, "filters": kept} if kept else None
    if f["kind"] == "not":
        inner = without_own(f["filter"], column)
        return {**f, "filter": inner} if inner else None
    return f


def literal(c: ColumnDef, value) -> Column:
    """A request's value as a literal of the column's kind; other kinds of value are refused."""
    kind = c.scalar
    ok = {
        "integer": isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63,
        "unsigned": isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 2**64,
        "real": isinstance(value, (int, float)) and not isinstance(value, bool),
        "boolean": isinstance(value, bool),
    }.get(kind, isinstance(value, str))
    if kind in ("json", "geo_point") or not ok:
        raise RequestError(f"{value!r} does not compare with the {kind} column {c.name}")
    try:
        if kind == "unsigned":
            return F.lit(str(value)).cast("decimal(20,0)")
        if kind == "real":
            return F.lit(float(value))
        if kind == "date":
            return F.lit(dt.date.fromisoformat(value))
        if kind == "date_time":
            moment = dt.datetime.fromisoformat(value)
            if moment.tzinfo is None:
                raise ValueError("no offset")
            return F.lit(moment.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")
        if kind == "timestamp":
            moment = dt.datetime.fromisoformat(value)
            if moment.tzinfo is not None:
                raise ValueError("an offset")
            return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")
        if kind == "blob":
            return F.lit(bytes.fromhex(value.removeprefix("0x")))
        if kind == "ip":
            return F.lit(ip_bytes(value))
    except ValueError as e:
        raise RequestError(f"{value!r} is no {kind}: {e}") from None
    return F.lit(value)


def ip_bytes(text: str) -> bytes:
    """16 bytes in numeric order; IPv4 mapped into IPv6."""
    a = ipaddress.ip_address(text)
    return (ipaddress.IPv6Address(b"\0" * 10 + b"\xff\xff" + a.packed) if a.version == 4 else a).packed


def _any_element(c: ColumnDef, test: Callable[[Column], Column]) -> Column:
    return F.exists(F.col(c.name), test) if c.is_array else test(F.col(c.name))


@dataclass
class Lowered:
    """A filter's predicate, and its score (None where it has none)."""

    where: Column
    score: Column | None = None


@dataclass
class Lowering:
    """Lowers the filters of one request; corpus statistics are gathered at most once, when a score is asked for."""

    table: Table
    stats: Stats = field(init=False)
    scored: bool = True

    def __post_init__(self) -> None:
        self.stats = Stats(self.table)

    def lower(self, f: dict) -> Lowered:
        rule = getattr(self, "_" + f.get("kind", "none"), None)
        if rule is None:
            raise RequestError(f"unknown filter {f.get('kind')!r}")
        if self.scored:
            self._want(f)
        return rule(f)

    def where(self, f: dict | None) -> Column:
        return F.lit(True) if f is None else self.lower(f).where

    # structural

    def _compare(self, f: dict) -> Lowered:
        c, op = self.table.indexed(f["column"]), f["operator"]
        value = literal(c, f["value"])
        if op == "not_equal":
            same = self._equal(c, value, f["value"])
            return Lowered(~holds(same))
        if op == "equal":
            return Lowered(self._equal(c, value, f["value"]))
        return Lowered(_any_element(c, lambda x: COMPARE[op](x, value)))

    @staticmethod
    def _equal(c: ColumnDef, value: Column, given) -> Column:
        if c.scalar == "facet":  # a path also stands for those below it
            return _any_element(c, lambda x: (x == value) | F.startswith(x, F.lit(given.rstrip("/") + "/")))
        return _any_element(c, lambda x: x == value)

    def _between(self, f: dict) -> Lowered:
        c = self.table.indexed(f["column"])
        low, high = literal(c, f["lower"]), literal(c, f["upper"])
        return Lowered(_any_element(c, lambda x: x.between(low, high)))

    def _in(self, f: dict) -> Lowered:
        c = self.table.indexed(f["column"])
        if not f["values"]:
            raise RequestError("IN needs a value")
        values = [literal(c, v) for v in dict.fromkeys(f["values"])]
        return Lowered(_any_element(c, lambda x: x.isin(*values)))

    def _is_null(self, f: dict) -> Lowered:
        c = self.table.indexed(f["column"])
        none = F.col(c.name).isNull()
        if c.kind == "geo_point_array":
            none = none | (F.size(c.name) == 0)
        return Lowered(~none if f.get("negated") else none)

    def _all(self, f: dict) -> Lowered:
        parts = self._parts(f)
        return Lowered(reduce(operator.and_, [p.where for p in parts]), _summed([p.score for p in parts]))

    def _any(self, f: dict) -> Lowered:
        parts = self._parts(f)
        own = [None if p.score is None else F.when(p.where, p.score).otherwise(F.lit(0.0)) for p in parts]
        return Lowered(reduce(operator.or_, [holds(p.where) for p in parts]), _summed(own))

    def _parts(self, f: dict) -> list[Lowered]:
        if not f["filters"]:
            raise RequestError(f"{f['kind']} needs a filter")
        return [self.lower(g) for g in f["filters"]]

    def _not(self, f: dict) -> Lowered:
        return Lowered(~holds(self.lower(f["filter"]).where))

    # geographic

    def _geo(self, f: dict) -> ColumnDef:
        c = self.table.indexed(f["column"])
        if c.scalar != "geo_point":
            raise RequestError(f"column {c.name} is not geographic")
        return c

    def _geo_distance(self, f: dict) -> Lowered:
        return Lowered(geo.near(self._geo(f), *geo.checked_point(f["center"]), float(f["radius_meters"])))

    def _geo_bounding_box(self, f: dict) -> Lowered:
        box = geo.checked_bounds(f["bounds"])
        return Lowered(geo.any_point(self._geo(f), lambda p: geo.in_box(p, *box)))

    def _geo_distance_compare(self, f: dict) -> Lowered:
        d = geo.distance(self._geo(f), *geo.checked_point(f["center"]), f.get("mode", "min"))
        value = F.lit(float(f["distance_meters"]))
        return Lowered(holds(d != value if f["operator"] == "not_equal" else COMPARE[f["operator"]](d, value)))

    # JSON

    def _json_compare(self, f: dict) -> Lowered:
        kind, op = f["data_type"], f["operator"]
        if kind == "bool" and op not in ("equal", "not_equal"):
            raise RequestError("booleans are equal or not")
        c = json_path.typed(self.table, f["column"], f["path"], kind)
        value = F.lit(f["value"]).cast(json_path.PATH_TYPES[kind])
        return Lowered(~holds(c == value) if op == "not_equal" else COMPARE[op](c, value))

    def _json_between(self, f: dict) -> Lowered:
        spark = json_path.PATH_TYPES[f["data_type"]]
        c = json_path.typed(self.table, f["column"], f["path"], f["data_type"])
        return Lowered(c.between(F.lit(f["lower"]).cast(spark), F.lit(f["upper"]).cast(spark)))

    def _json_exists(self, f: dict) -> Lowered:
        if f.get("data_type"):
            json_path.check_type(self.table, f["column"], f["path"], f["data_type"])
        v = json_path.variant_at(self.table, f["column"], f["path"])
        there = v.isNotNull() & ~F.is_variant_null(v)
        return Lowered(~holds(there) if f.get("negated") else holds(there))

    def _json_search(self, f: dict) -> Lowered:
        text = F.try_variant_get(F.try_parse_json(F.col(json_path.json_column(self.table, f["column"]))), json_path._path(f["path"]), "string")
        inner = Table.of(self.table.df.select(F.col(self.table.key), text.alias("json_text")), self.table.key)
        found, tree = parse_terms(f["query"]), parse(f["query"])
        stats = Stats(inner)
        stats.want("json_text", found)
        if self.scored:
            stats._load()
        stats.table = _ExpressionTable(inner, tokens(text, "default"))
        return Lowered(*Clauses(stats.table, {"json_text": 1.0}, stats if self.scored else None).lower(tree))

    # text

    def _fields(self, names) -> list[str]:
        return [self.table.indexed(n).name for n in names] or self.table.text_columns()

    def _want(self, f: dict) -> None:
        """Announce the terms of a search before its statistics are read."""
        if f["kind"] in ("search", "search_boosted", "disjunction_max"):
            for name in self._fields(f["fields"]):
                for field_, text in _leaves(parse(f["query"])):
                    if field_ is None or self.table.column(field_).name == name:
                        self.stats.want(name, analyze(text, self.table.column(name).analyzer))
        for g in f.get("filters", [f["filter"]] if f["kind"] == "not" else []):
            self._want(g)

    def _clauses(self, fields: dict[str, float]) -> Clauses:
        return Clauses(self.table, fields, self.stats if self.scored else None)

    def _search(self, f: dict) -> Lowered:
        fields = dict.fromkeys(self._fields(f["fields"]), 1.0)
        return Lowered(*self._clauses(fields).lower(parse(f["query"])))

    def _search_boosted(self, f: dict) -> Lowered:
        if not all(0 < b < float("inf") for b in f["fields"].values()):
            raise RequestError("boosts are finite and above 0")
        fields = {self.table.indexed(n).name: float(b) for n, b in f["fields"].items()}
        return Lowered(*self._clauses(fields).lower(parse(f["query"], f.get("conjunction_by_default", False))))

    def _disjunction_max(self, f: dict) -> Lowered:
        tie = float(f.get("tie_breaker", 0))
        if not 1 <= len(f["fields"]) <= 32 or not 0 <= tie <= 1:
            raise RequestError("disjunction_max takes 1 to 32 fields and a tie breaker of 0 to 1")
        parts = [self._clauses({self.table.indexed(n).name: float(b)}).lower(parse(f["query"])) for n, b in f["fields"].items()]
        where = reduce(operator.or_, [holds(w) for w, _ in parts])
        if not self.scored:
            return Lowered(where)
        own = [F.when(w, s).otherwise(F.lit(0.0)) for w, s in parts]
        best = F.greatest(*own) if len(own) > 1 else own[0]
        return Lowered(where, best + F.lit(tie) * (reduce(operator.add, own) - best))

    def _one_token(self, f: dict) -> tuple[Column, str]:
        c = self.table.indexed(f["column"])
        found = analyze(f["value"], c.analyzer)
        if len(found) != 1:
            raise RequestError(f"{f['value']!r} is not one token")
        return self.table.tokens(c.name), found[0]

    def _fuzzy(self, f: dict) -> Lowered:
        found, q = self._one_token(f)
        d = f.get("distance", 1)
        if not 0 <= d <= 2:
            raise RequestError("the distance is 0 to 2")
        near = F.exists(found, lambda t: F.levenshtein(t, F.lit(q), d) >= 0)
        if f.get("transposition_cost_one"):
            near = near | F.exists(found, lambda t: _transposed(t, q, d))
        return Lowered(near, F.lit(1.0))

    def _prefix(self, f: dict) -> Lowered:
        found, q = self._one_token(f)
        return Lowered(F.exists(found, lambda t: F.startswith(t, F.lit(q))), F.lit(1.0))

    def _positions(self, name: str) -> ColumnDef:
        c = self.table.indexed(name)
        if c.record != "positions":
            raise RequestError(f"column {c.name} keeps no positions")
        return c

    def _phrase_prefix(self, f: dict) -> Lowered:
        c = self._positions(f["column"])
        found = analyze(f["phrase"], c.analyzer)
        if not 2 <= len(found) <= 32 or len(f["phrase"].encode()) > 1024:
            raise RequestError("a phrase prefix has 2 to 32 tokens and 1024 bytes at most")
        _expansions(f, 50, 4096)
        n, lead = len(found), F.array(*map(F.lit, found[:-1]))

        def somewhere(ts: Column) -> Column:
            at = F.exists(F.sequence(F.lit(1), F.size(ts) - n + 1), lambda i: (F.element_at(ts, i) == found[0]) & (F.slice(ts, i, n - 1) == lead) & F.startswith(F.get(ts, i + (n - 2)), F.lit(found[-1])))
            return F.when(F.size(ts) >= n, at).otherwise(F.lit(False))

        return Lowered(bind(self.table.tokens(c.name), somewhere), F.lit(1.0))

    def _regex(self, f: dict) -> Lowered:
        return Lowered(F.exists(self.table.tokens(f["column"]), lambda t: t.rlike(_whole(f["pattern"]))), F.lit(1.0))

    def _regex_phrase(self, f: dict) -> Lowered:
        c, patterns, slop = self._positions(f["column"]), [_whole(p) for p in f["patterns"]], f.get("slop", 0)
        if not 2 <= len(patterns) <= 16 or not 0 <= slop <= 64:
            raise RequestError("a regex phrase has 2 to 16 patterns and a slop of 64 at most")
        _expansions(f, 4096, 16_384)
        tokens = self.table.tokens(c.name)
        # reachable: the ends of matches of the first k patterns with the fewest skipped tokens, advanced pattern by pattern
        ends = F.transform(tokens, lambda t, i: F.when(t.rlike(patterns[0]), F.lit(0)))
        for p in patterns[1:]:
            ends = _advance(tokens, ends, p, slop)
        return Lowered(F.exists(ends, lambda x: x.isNotNull()), F.lit(1.0))


def _expansions(f: dict, usual: int, most: int) -> None:
    """max_expansions bounds the terms that an index would try. Here rows are tested one by one and none are left out."""
    if not 1 <= f.get("max_expansions", usual) <= most:
        raise RequestError(f"max_expansions is 1 to {most}")


def _advance(tokens: Column, ends: Column, pattern: str, slop: int) -> Column:
    """Fewest tokens skipped so far by a match that ends at each place, given those of one pattern less."""
    def at(before: Column, t: Column, i: Column) -> Column:
        options = [F.get(before, i - 1 - k) + k for k in range(slop + 1)]
        best = F.least(*options) if len(options) > 1 else options[0]
        return F.when(t.rlike(pattern) & (best <= slop), best)

    # the places so far are bound once, so that the expression grows by a term for each pattern
    return F.get(F.transform(F.array(ends), lambda before: F.transform(tokens, lambda t, i: at(before, t, i))), F.lit(0))


def _whole(pattern: str) -> str:
    if not 1 <= len(pattern.encode()) <= 512:
        raise RequestError("a pattern has 1 to 512 bytes")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RequestError(f"bad pattern {pattern!r}: {e}") from None
    return f"^(?:{pattern})$"


def _transposed(t: Column, q: str, distance: int) -> Column:
    """Within the distance once one or two pairs of neighbouring letters of the query are swapped, each at cost one."""
    swaps = [q[:k] + q[k + 1] + q[k] + q[k + 2 :] for k in range(len(q) - 1) if q[k] != q[k + 1]]
    near = [F.levenshtein(t, F.lit(s), distance - 1) >= 0 for s in swaps] if distance else []
    if distance == 2:
        twice = {s[:k] + s[k + 1] + s[k] + s[k + 2 :] for s in swaps for k in range(len(s) - 1)}
        near.append(t.isin(*sorted(twice)) if twice else F.lit(False))
    return reduce(operator.or_, near, F.lit(False))


def _summed(parts: list[Column | None]) -> Column | None:
    known = [p for p in parts if p is not None]
    return reduce(operator.add, known) if known else None


def parse_terms(query: str) -> list[str]:
    return [t for _, text in _leaves(parse(query)) for t in analyze(text, "default")]


def _leaves(tree: tuple):
    if tree[0] in ("term", "phrase"):
        yield tree[1], tree[2]
    else:
        for part in tree[1] if isinstance(tree[1], list) else [tree[1]]:
            yield from _leaves(part)


@dataclass
class _ExpressionTable:
    """A table whose one text column is an expression over another table's row."""

    inner: Table
    expression: Column

    @property
    def df(self):
        return self.inner.df

    def tokens(self, name: str) -> Column:
        return self.expression

    def column(self, name: str) -> ColumnDef:
        return self.inner.column(name)


@dataclass
class Clauses:
    """A parsed search over fields with boosts: where it matches, and what it scores."""

    table: Table | _ExpressionTable
    fields: dict[str, float]
    stats: Stats | None

    def lower(self, tree: tuple) -> tuple[Column, Column | None]:
        kind = tree[0]
        if kind in ("term", "phrase"):
            return self._leaf(tree)
        if kind == "not":
            return ~holds(self.lower(tree[1])[0]), None
        parts = [self.lower(p) for p in tree[1]]
        own = [None if s is None else F.when(holds(w), s).otherwise(F.lit(0.0)) for w, s in parts]
        if kind == "and":
            return reduce(operator.and_, [holds(w) for w, _ in parts]), _summed(own)
        return (F.lit(True) if kind == "maybe" else reduce(operator.or_, [holds(w) for w, _ in parts])), _summed(own)

    def _leaf(self, tree: tuple) -> tuple[Column, Column | None]:
        _, only, text = tree
        wheres, scores_ = [], []
        for name, boost in self.fields.items():
            if only is not None and self.table.column(only).name != name:
                continue
            found = analyze(text, self.table.column(name).analyzer)
            if not found:
                continue
            tokens = self.table.tokens(name)
            wheres.append(F.array_contains(tokens, found[0]) if len(found) == 1 else contains_phrase(tokens, found))
            if self.stats is not None:
                self.stats.want(name, found)
                scores_.append(self.stats.score(name, found, boost))
        if only is not None and not wheres:
            raise RequestError(f"{only} is not a searched field")
        return (reduce(operator.or_, [holds(w) for w in wheres]) if wheres else F.lit(False)), _summed(scores_)
