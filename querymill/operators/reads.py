"""Typed reads: filter, score, sort, page and project one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions import geo, json_path
from querymill.functions.highlight import highlighted
from querymill.operators import groups
from querymill.plans.filters import LARGE_IN, Lowered, Lowering, holds, literal, scores, searched
from querymill.table import RequestError, Table

DEFAULT_LIMIT = 100


@dataclass
class Page:
    """Rows of a read, lazy, and the values that the next page starts after (None: this is the last)."""

    df: DataFrame
    next_search_after: list | None = None


@dataclass
class _Order:
    expression: Column
    descending: bool
    name: str

    def column(self) -> Column:
        # ascending puts nulls last, descending first
        return self.expression.desc_nulls_first() if self.descending else self.expression.asc_nulls_last()


def read(table: Table, request: dict) -> DataFrame:
    """The rows of a request, as a lazy DataFrame."""
    return _plan(table, request)[0]


def _plan(table: Table, request: dict, extra: int = 0) -> tuple[DataFrame, list[_Order]]:
    projection = request.get("projection") or [{"kind": "column", "column": c} for c in table.columns]
    limit, offset = request.get("limit", DEFAULT_LIMIT), request.get("offset", 0)
    table, filter_ = _join_large_in(table, request.get("filter"))
    if request.get("group_by") or any(p["kind"] == "aggregate" for p in projection):
        where = Lowering(table, scored=False).where(filter_)
        return groups.tabular(table.with_df(table.df.where(where)), projection, request.get("group_by", []), request.get("order_by", []), limit, offset, request.get("max_groups")), []
    asked = any(p["kind"] == "score" for p in projection) or any(s["column"] == "_score" for s in request.get("order_by", [])) or request.get("min_score") is not None
    implied = scores(filter_) and not request.get("order_by")
    table = table.tokenised(*searched(table, filter_))
    found = Lowering(table, scored=asked or implied).lower(filter_) if filter_ else Lowered(F.lit(True))
    df = table.df.where(found.where) if filter_ else table.df
    if asked or implied:
        df = df.withColumn("_score", F.lit(0.0) if found.score is None else found.score)
    if request.get("min_score") is not None:
        df = df.where(F.col("_score") >= request["min_score"])
    order = _order(table, request.get("order_by") or ([{"column": "_score", "descending": True}] if implied else []), projection)
    if request.get("search_after") is not None:
        df = df.where(_after(table, order, request["search_after"], offset))
    if order:
        df = df.orderBy(*[o.column() for o in order])
    df = df.offset(offset) if offset else df
    projection = [{"query": _query_for(filter_, p["column"]), **p} if p["kind"] == "highlight" else p for p in projection]
    return df.limit(limit + extra).select(*[_projected(table, p) for p in projection], *[o.expression.alias(f"__qm_{k}") for k, o in enumerate(order) if extra]), order


def _query_for(f: dict | None, column: str) -> str:
    """The words that a filter searches for in a column, for its highlights."""
    if f is None:
        return ""
    if f["kind"] in ("all", "any"):
        return " ".join(filter(None, (_query_for(g, column) for g in f["filters"])))
    if f["kind"] in ("search", "search_boosted", "disjunction_max"):
        return f["query"] if not f["fields"] or column in f["fields"] else ""
    return f.get("value") or f.get("phrase") or "" if f["kind"] in ("fuzzy", "prefix", "phrase_prefix") and f["column"] == column else ""


def _join_large_in(table: Table, f: dict | None) -> tuple[Table, dict | None]:
    """A top-level IN of very many values becomes a semi-join, which Spark may broadcast or shuffle."""
    parts = f["filters"] if f and f["kind"] == "all" else [f] if f else []
    large = [g for g in parts if g["kind"] == "in" and len(g["values"]) > LARGE_IN and not table.column(g["column"]).is_array]
    for g in large:
        c = table.indexed(g["column"])
        values = table.df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(g["values"])], f"`{c.name}` {c.data_type().simpleString()}")
        table = table.with_df(table.df.join(values, c.name, "left_semi"))
    rest = [g for g in parts if g not in large]
    return table, ({"kind": "all", "filters": rest} if len(rest) > 1 else rest[0] if rest else None) if large else f


def _order(table: Table, order_by: list[dict], projection: list[dict]) -> list[_Order]:
    out = []
    aliases = {p["alias"]: p for p in projection if p.get("alias")}
    for s in order_by:
        name, down = s["column"], s.get("descending", False)
        if name == "_score":
            out.append(_Order(F.col("_score"), down, name))
        elif name in aliases:
            out.append(_Order(_value(table, aliases[name]), down, name))
        elif s.get("json_path"):
            if not s.get("json_type"):
                raise RequestError("sorting by a JSON path needs its type")
            out.append(_Order(json_path.typed(table, name, s["json_path"], s["json_type"]), down, name))
        elif s.get("geo_distance_from"):
            c = table.indexed(name)
            out.append(_Order(geo.distance(c, *geo.checked_point(s["geo_distance_from"]), s.get("geo_distance_mode", "min")), down, name))
        else:
            c = table.column(name)
            if c.is_array or c.kind == "geo_point":
                raise RequestError(f"cannot sort by the {c.kind} column {c.name}")
            # whole objects go by their variants' text, which has sorted keys
            out.append(_Order(F.to_json(F.try_parse_json(F.col(c.name))) if c.kind == "json" else F.col(c.name), down, c.name))
    if out and not any(o.name in ("_score", table.key) for o in out):
        out.append(_Order(F.col(table.key), False, table.key))
    elif out and out[-1].name == "_score":
        out.append(_Order(F.col(table.key), False, table.key))  # equal scores go by key, so that pages are stable
    return out


def _after(table: Table, order: list[_Order], values: list, offset: int) -> Column:
    """Rows beyond the given sort values: greater in the first key, or equal there and greater in the next, and so on."""
    if not order or offset or len(values) != len(order) or any(v is None for v in values):
        raise RequestError("search_after takes a value for each sort key, the table's key included, and no offset")
    out, same = F.lit(False), F.lit(True)
    for o, v in zip(order, values):
        if o.name in table.columns and table.column(o.name).scalar not in ("geo_point", "json"):
            v = literal(table.column(o.name), v)
        else:
            v = F.lit(v)
        beyond = (o.expression < v) if o.descending else (o.expression > v) | o.expression.isNull()
        out = out | (same & holds(beyond))
        same = same & holds(o.expression == v)
    return out


def _value(table: Table, p: dict) -> Column:
    kind = p["kind"]
    if kind == "column":
        return F.col(table.column(p["column"]).name)
    if kind == "score":
        return F.col("_score")
    if kind == "geo_distance":
        return geo.distance(table.indexed(p["column"]), *geo.checked_point(p["from"]), p.get("mode", "min"))
    if kind == "highlight":
        return F.col(table.indexed(p["column"]).name)
    raise RequestError(f"unknown projection {kind}")


def _projected(table: Table, p: dict) -> Column:
    kind = p["kind"]
    if kind == "column":
        return _value(table, p).alias(p.get("alias") or p["column"])
    if kind == "score":
        return F.col("_score").alias(p.get("alias") or "_score")
    if kind == "geo_distance":
        return _value(table, p).alias(p.get("alias") or f"{p['column']}_distance_meters")
    if kind == "highlight":
        c, size = table.indexed(p["column"]), p.get("fragment_size", 160)
        if c.kind != "text" or not 32 <= size <= 4096:
            raise RequestError("highlights are of text columns, with fragments of 32 to 4096 characters")
        return highlighted(F.col(c.name), p["query"], c.analyzer, size).alias(p.get("alias") or p["column"])
    raise RequestError(f"unknown projection {kind}")


def read_page(table: Table, request: dict) -> Page:
    """A page of a sorted read and the cursor of the next. One row more than the page is read, to know if there is one."""
    limit = request.get("limit", DEFAULT_LIMIT)
    df, order = _plan(table, {**request, "limit": limit}, extra=1)
    if not order:
        raise RequestError("a page with a cursor needs an order")
    rows = df.collect()  # limit + 1 rows
    names = [c for c in df.columns if not c.startswith("__qm_")]
    cursor = [rows[limit - 1][f"__qm_{k}"] for k in range(len(order))] if len(rows) > limit > 0 else None
    plain = df.sparkSession.createDataFrame(rows[:limit], df.schema).select(*names)
    return Page(plain, [str(v) if hasattr(v, "isoformat") else v for v in cursor] if cursor else None)


def matching(table: Table, filter_: dict | None) -> DataFrame:
    """All columns of all rows that match a filter."""
    own = table.df.columns
    table = table.tokenised(*searched(table, filter_))
    return table.df.where(Lowering(table, scored=False).where(filter_)).select(*[F.col(f"`{c}`") for c in own])


def count(table: Table, filter_: dict | None = None) -> int:
    return matching(table, filter_).count()


def list_rows(table: Table, q: str | None = None, sort: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows by key, or by another column, that match a search over all text columns."""
    if not 1 <= limit <= 1000:
        raise RequestError("the limit is 1 to 1000")
    f = {"kind": "search", "fields": [], "query": q} if q else None
    return read(table, {"filter": f, "order_by": [{"column": sort or table.key, "descending": descending}], "limit": limit, "offset": offset})


def explain(table: Table, request: dict) -> str:
    """The strategy Spark chose for a request, before its plan."""
    df = read(table, request)
    plan = df._jdf.queryExecution().toString()
    label = "aggregate" if "Aggregate" in plan else "top-k" if "TakeOrdered" in plan else "limit" if "Limit" in plan else "scan"
    return f"{label}\n{plan}"


def profile(table: Table, request: dict) -> dict:
    """Seconds to plan and to run a read, and its rows."""
    import time

    began = time.perf_counter()
    df = read(table, request)
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    rows = df.count()
    return {"plan_seconds": planned - began, "run_seconds": time.perf_counter() - planned, "rows": rows}


def explain_score(table: Table, filter_: dict, key_value) -> DataFrame:
    """key, N, df, idf, tf, length, average length and score of each term of a search in one row."""
    from querymill.plans.filters import _leaves, parse
    from querymill.plans.scoring import phrase_count
    from querymill.functions.text import analyze

    lowering = Lowering(table)
    found = lowering.lower(filter_)
    row = table.df.where(found.where & (F.col(table.key) == F.lit(key_value)))
    if row.count() != 1:
        raise RequestError("the key names no row that matches")
    parts = []
    for name in filter_["fields"] or table.text_columns():
        tokens = table.tokens(name)
        for _, text in _leaves(parse(filter_["query"])):
            terms = analyze(text, table.column(name).analyzer)
            idf = sum(lowering.stats.idf(name, t) for t in terms)
            parts.append(F.struct(F.lit(name).alias("field"), F.lit(" ".join(terms)).alias("term"), F.lit(idf).alias("idf"), phrase_count(tokens, terms).alias("tf"), F.size(tokens).alias("length"), F.lit(lowering.stats.average_length(name)).alias("average_length"), lowering.stats.score(name, terms).alias("score")))
    return row.select(F.col(table.key), F.explode(F.array(*parts)).alias("x"), found.score.alias("total")).select(table.key, "x.*", "total")
