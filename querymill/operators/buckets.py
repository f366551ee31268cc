"""Recursive bucket and metric aggregations.

Each node lowers to a flat DataFrame: the keys of the buckets above it and its own (<name>_key), doc_count, and its metrics.
`aggregate` returns one lazy frame for each node of the request, named by its path; `nested` renders them as one JSON
tree.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions import geo, json_path
from querymill.operators.groups import check_group_count
from querymill.plans.filters import Lowering, literal
from querymill.table import RequestError, Table

MAX_DEPTH, MAX_NAMES, MAX_SIZE = 4, 100, 10_000
PERCENTS = [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0]
MICROS = {"ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
EPOCH_WEEK = {"year": "year", "month": "month", "week": "week"}


def duration(text: str) -> int:
    """Microseconds of 1d, 12h, 30m, 10s, 5ms."""
    m = re.fullmatch(r"(-?\d+)(ms|s|m|h|d)", text)
    if not m:
        raise RequestError(f"bad interval {text!r}")
    return int(m[1]) * MICROS[m[2]]


def micros(table: Table, name: str) -> Column:
    c = table.column(name)
    if c.kind not in ("date", "date_time", "timestamp"):
        raise RequestError(f"{c.name} is not a date column")
    col = F.col(c.name)
    return F.unix_micros(col.cast("timestamp") if c.kind != "timestamp" else F.to_utc_timestamp(col.cast("timestamp"), F.current_timezone()))


def aggregate(table: Table, request: dict[str, dict], filter_: dict | None = None, max_buckets: int | None = None) -> dict[str, DataFrame]:
    """{path: frame} for all nodes, over the rows that match a filter. More buckets of one node than max_buckets are an error."""
    if len(request) > MAX_NAMES:
        raise RequestError(f"at most {MAX_NAMES} aggregations")
    base = table.with_df(table.df.where(Lowering(table, scored=False).where(filter_)) if filter_ else table.df)
    out: dict[str, DataFrame] = {}
    for name, node in request.items():
        _lower(base, base.df, [], name, node, 1, out)
    return {path: check_group_count(df, max_buckets) for path, df in out.items()} if max_buckets is not None else out


def _lower(table: Table, df: DataFrame, keys: list[str], path: str, node: dict, depth: int, out: dict[str, DataFrame]) -> None:
    if depth > MAX_DEPTH:
        raise RequestError(f"aggregations nest {MAX_DEPTH} deep")
    kind = node["kind"]
    if kind == "metric":
        out[path] = _grouped(df, keys, metrics(table, node))
        return
    if kind == "top_hits":
        out[path] = top_hits(table, df, keys, node, depth)
        return
    if kind == "geo_tile_grid":
        if depth > 1:
            raise RequestError("geo_tile_grid stands at the top")
        out[path] = geo_tile_grid(table, df, node)
        return
    rule = RULES.get(kind)
    if rule is None:
        raise RequestError(f"unknown aggregation {kind}")
    children = node.get("aggregations", {})
    inline = {n: c for n, c in children.items() if c["kind"] == "metric"}
    extra = [m.alias(f"{n}_{m_name}" if m_name != "value" else n) for n, c in inline.items() for m_name, m in _metrics(table, c).items()]
    extra = [F.count(F.lit(1)).alias("doc_count"), *extra]
    members, own = rule(table, df, keys, path.rsplit(".", 1)[-1], node, extra)
    out[path] = own
    deeper = {n: c for n, c in children.items() if c["kind"] != "metric"}
    if deeper:
        mine = [c for c in own.columns if c.endswith("_key") and c not in keys]
        kept = members if kind == "filter" or not keys + mine else _join(members, own.select(*keys, *mine), [*keys, *mine], "left_semi")
        for n, c in deeper.items():
            _lower(table, kept, keys + mine, f"{path}.{n}", c, depth + 1, out)


def _join(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by keys where null equals null, for a bucket may be that of the missing values. No keys: both have one row."""
    if not keys:
        return df.join(other, how="cross")
    named = other.select(*[F.col(k).alias(f"__qm_on_{n}") for n, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named[f"__qm_on_{n}"]) for n, k in enumerate(keys)])
    return df.join(named, same, how).drop(*[f"__qm_on_{n}" for n in range(len(keys))])


# metrics

#: An exact percentile's rank is found in the bits of the values, so many at a time from the top.
DIGIT_BITS, DIGITS = 16, 4


@dataclass(frozen=True)
class Percentile:
    """An exact percentile. It stands among a node's metrics, but is no aggregate function: see _percentiles."""

    value: Column
    share: float
    name: str = "value"

    def alias(self, name: str) -> Percentile:
        return Percentile(self.value, self.share, name)


def _grouped(df: DataFrame, keys: list[str], found: list[Column | Percentile]) -> DataFrame:
    """The metrics of each group, or of all rows."""
    plain, exact = [m for m in found if isinstance(m, Column)], {}
    for m in found:
        if isinstance(m, Percentile):
            exact.setdefault(id(m.value), []).append(m)
    own = [df.groupBy(*keys).agg(*plain)] if plain else []
    names = iter(own[0].columns[len(keys) :] if plain else [])
    order = [next(names) if isinstance(m, Column) else m.name for m in found]
    own += [_percentiles(df, keys, ms) for ms in exact.values()]
    return reduce(lambda a, b: _join(a, b, keys, "left"), own).select(*keys, *order)


def _sortable(df: DataFrame, name: str, out: str) -> DataFrame:
    """With a long for each double of a column, in the same order: its bits, negated below zero. NaN comes last."""
    c, inf = F.col(name), F.lit(float("inf"))
    size = F.when(F.abs(c) < inf, F.abs(c))
    power = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.coalesce(F.floor(F.log2(size)), F.lit(-1022)))).cast("int")  # one off at most, by rounding
    high, low = F.col("__qm_x") >= 2, (F.col("__qm_x") < 1) & (F.col("__qm_e") > -1022)
    bits = (F.col("__qm_e") + F.when(high, 1).when(low, -1).otherwise(0) + 1022).cast("long") * F.lit(1 << 52) + F.floor(F.col("__qm_x") * F.when(high, 0.5).when(low, 2.0).otherwise(1.0) * F.lit(2.0**52))
    bits = F.coalesce(bits, F.when(F.isnan(c), F.lit((2047 << 52) + 1)).otherwise(F.lit(2047 << 52)))
    return df.withColumn("__qm_e", power).withColumn("__qm_x", size * F.pow(F.lit(2.0), -F.col("__qm_e"))).withColumn(out, F.when(c < 0, -bits).otherwise(bits)).drop("__qm_e", "__qm_x")


def _percentiles(df: DataFrame, keys: list[str], wanted: list[Percentile]) -> DataFrame:
    """Exact percentiles of one value by group, interpolated between the two ranks around each.

    Rows are counted by value, then by its leading 48, 32 and 16 bits. From the top, each count's running sum tells in which
    prefix a rank lies, and only that prefix is looked into below, so no task orders more than 65 536 counts for a group's rank.
    """
    by = [F.col(k) for k in keys]
    counted = df.select(*keys, wanted[0].value.cast("double").alias("__qm_v")).where(F.col("__qm_v").isNotNull()).groupBy(*keys, "__qm_v").agg(F.count(F.lit(1)).alias("__qm_n"))
    levels = [_sortable(counted, "__qm_v", "__qm_at")]
    for _ in range(DIGITS - 1):
        levels.append(levels[-1].groupBy(*by, F.shiftright("__qm_at", DIGIT_BITS).alias("__qm_at")).agg(F.sum("__qm_n").alias("__qm_n")))

    def position(share: float) -> Column:
        return (F.col("__qm_total") - 1) * F.lit(share)

    def running(level: DataFrame, within: list[str]) -> DataFrame:
        rows = Window.partitionBy(*within).orderBy("__qm_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return level.withColumn("__qm_past", F.sum("__qm_n").over(rows)).withColumn("__qm_before", F.col("__qm_past") - F.col("__qm_n"))

    holds = (F.col("__qm_before") <= F.col("__qm_rank")) & (F.col("__qm_rank") < F.col("__qm_past"))
    top = running(levels[-1], keys).withColumn("__qm_total", F.sum("__qm_n").over(Window.partitionBy(*keys)))
    ranks = [F.struct(F.lit(2 * n + up).alias("i"), end(position(m.share)).cast("long").alias("r")) for n, m in enumerate(wanted) for up, end in enumerate((F.floor, F.ceil))]
    found = top.select("*", F.explode(F.array(*ranks)).alias("__qm_a")).select("*", F.col("__qm_a.i").alias("__qm_i"), F.col("__qm_a.r").alias("__qm_rank")).where(holds)
    for level in levels[-2::-1]:
        found = found.select(*keys, "__qm_i", "__qm_total", F.col("__qm_at").alias("__qm_in"), (F.col("__qm_rank") - F.col("__qm_before")).alias("__qm_rank"))
        inside = _join(level.withColumn("__qm_in", F.shiftright("__qm_at", DIGIT_BITS)), found if keys else F.broadcast(found), [*keys, "__qm_in"], "inner")
        found = running(inside, [*keys, "__qm_i"]).where(holds)

    def value(n: int, m: Percentile) -> Column:
        low, high = (F.max(F.when(F.col("__qm_i") == 2 * n + up, F.col("__qm_v"))) for up in (0, 1))
        at = F.max(position(m.share))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(m.name)

    return found.groupBy(*keys).agg(*[value(n, m) for n, m in enumerate(wanted)])


def _target(table: Table, node: dict) -> Column:
    if (node.get("column") is None) == (node.get("json_path") is None):
        if node.get("column") is None and node["function"] == "count":
            return F.col(table.key)
        raise RequestError("a metric has one column or JSON path")
    if p := node.get("json_path"):
        if p["data_type"] not in json_path.NUMERIC and node["function"] not in ("count", "cardinality"):
            raise RequestError("a metric's JSON path is numeric")
        c = json_path.typed(table, p["column"], p["path"], p["data_type"])
    else:
        c = F.col(table.column(node["column"]).name)
    return F.coalesce(c, F.lit(node["missing"])) if node.get("missing") is not None else c


def _metrics(table: Table, node: dict) -> dict[str, Column | Percentile]:
    """cardinality and percentiles are sketched, or, with `exact`, counted and interpolated."""
    c, function = _target(table, node), node["function"]
    simple = {"count": lambda: F.count(c), "sum": lambda: F.sum(c).cast("double"), "average": lambda: F.avg(c).cast("double"), "min": lambda: F.min(c).cast("double"), "max": lambda: F.max(c).cast("double"), "cardinality": lambda: F.count_distinct(c) if node.get("exact") else F.approx_count_distinct(c)}
    if function in simple:
        return {"value": simple[function]()}
    if function == "percentiles":
        percents = node.get("percents") or PERCENTS
        return {f"p{p:g}".replace(".", "_"): Percentile(c, p / 100) if node.get("exact") else F.percentile_approx(c.cast("double"), p / 100, 10_000) for p in percents}
    basic = {"count": F.count(c), "sum": F.sum(c).cast("double"), "average": F.avg(c).cast("double"), "min": F.min(c).cast("double"), "max": F.max(c).cast("double")}
    if function == "stats":
        return basic
    if function == "extended_stats":
        d = c.cast("double")
        return basic | {"sum_of_squares": F.sum(d * d), "variance": F.var_pop(d), "variance_sampling": F.var_samp(d), "std_deviation": F.stddev_pop(d), "std_deviation_sampling": F.stddev_samp(d)}
    raise RequestError(f"unknown metric {function}")


def metrics(table: Table, node: dict) -> list[Column | Percentile]:
    return [m.alias(n) for n, m in _metrics(table, node).items()]


# buckets


def _ordered(df: DataFrame, keys: list[str], key: str, order: dict | None, size: int) -> DataFrame:
    """The first buckets of each bucket above: by count, key or a child metric; ties by key."""
    if not 1 <= size <= MAX_SIZE:
        raise RequestError(f"the size is 1 to {MAX_SIZE}")
    target = (order or {}).get("target", "_count")
    c = F.col({"_count": "doc_count", "_key": key}.get(target, target))
    down = order["descending"] if order and "descending" in order else order is None
    by = [c.desc_nulls_last() if down else c.asc_nulls_last(), F.col(key).asc_nulls_last()]
    if not keys:
        return df.orderBy(*by).limit(size)
    return df.withColumn("__qm_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("__qm_r") <= size).drop("__qm_r")


def _terms_of(df: DataFrame, keys: list[str], value: Column, name: str, node: dict, extra: list[Column | Percentile]) -> tuple[DataFrame, DataFrame]:
    key = f"{name}_key"
    members = df.withColumn(key, value).where(F.col(key).isNotNull())
    own = _grouped(members, [*keys, key], extra)
    if (least := node.get("min_doc_count")) is not None:
        own = own.where(F.col("doc_count") >= least)
    return members, _ordered(own, keys, key, node.get("order"), node.get("size", 10))


def terms(table: Table, df: DataFrame, keys: list[str], name: str, node: dict, extra: list[Column | Percentile]) -> tuple[DataFrame, DataFrame]:
    c = table.column(node["column"])
    if c.scalar in ("geo_point", "json"):
        raise RequestError(f"no terms of the {c.kind} column {c.name}")
    if node.get("segment_size") is not None and not node.get("size", 10) <= node["segment_size"] <= 100_000:
        raise RequestError("segment_size is size to 100000")
    missing = literal(c, node["missing"]) if node.get("missing") is not None else None
    if c.is_array:  # a row counts once in each of its elements' buckets
        df = df.withColumn("__qm_e", F.explode_outer(F.array_distinct(c.name)))
        value = F.col("__qm_e") if missing is None else F.coalesce("__qm_e", missing)
        members, own = _terms_of(df, keys, value, name, node, extra)
        return members.drop("__qm_e"), own
    value = F.col(c.name) if missing is None else F.coalesce(F.col(c.name), missing)
    return _terms_of(df, keys, value, name, node, extra)


def json_terms(table: Table, df: DataFrame, keys: list[str], name: str, node: dict, extra: list[Column | Percentile]) -> tuple[DataFrame, DataFrame]:
    t = node["target"]
    value = json_path.typed(table, t["column"], t["path"], t["data_type"])
    if node.get("missing") is not None:
        value = F.coalesce(value, F.lit(node["missing"]).cast(json_path.PATH_TYPES[t["data_type"]]))
    return _terms_of(df, keys, value, name, node, extra)


def _spaced(df: DataFrame, keys: list[str], name: str, value: Column, interval, offset, node: dict, bounds, extra: list[Column | Percentile], to_key) -> tuple[DataFrame, DataFrame]:
    """Fixed-width buckets. hard_bounds drop values; min_doc_count 0 adds the empty buckets between the ends (and extended_bounds)."""
    key, step = f"{name}_key", f"__qm_step_{name}"
    hard, wide = bounds(node.get("hard_bounds")), bounds(node.get("extended_bounds"))
    place = F.floor((value - F.lit(offset)) / F.lit(interval)).cast("long")
    members = df.withColumn("__qm_v", value).where(F.col("__qm_v").isNotNull())
    if hard:
        members = members.where(F.col("__qm_v").between(F.lit(hard[0]), F.lit(hard[1])))
    members = members.withColumn(step, place).drop("__qm_v").withColumn(key, to_key(F.col(step)))
    own = _grouped(members, [*keys, step], extra)
    least = node.get("min_doc_count", 0)
    if least == 0:
        ends = members.groupBy(*keys).agg(F.min(step).alias("a"), F.max(step).alias("b")).where("a IS NOT NULL")
        if wide:
            to_step = lambda v: F.floor((F.lit(v) - F.lit(offset)) / F.lit(interval)).cast("long")
            ends = ends.withColumns({"a": F.least("a", to_step(wide[0])), "b": F.greatest("b", to_step(wide[1]))})
        guarded = F.when(F.col("b") - F.col("a") < MAX_SIZE, F.sequence("a", "b")).otherwise(F.raise_error(F.lit(f"{name} has more than {MAX_SIZE} buckets")))
        filled = ends.select(*keys, F.explode(guarded).alias(step))
        own = _join(filled, own, [*keys, step], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long")))
    else:
        own = own.where(F.col("doc_count") >= least)
    rest = [c for c in own.columns if c not in (*keys, step)]
    return members.drop(step), own.select(*keys, to_key(F.col(step)).alias(key), *rest)


def histogram(table: Table, df: DataFrame, keys: list[str], name: str, node: dict, extra: list[Column | Percentile]) -> tuple[DataFrame, DataFrame]:
    if node["kind"] == "json_histogram":
        t = node["target"]
        if t["data_type"] not in json_path.NUMERIC:
            raise RequestError("a histogram's JSON path is numeric")
        value = json_path.typed(table, t["column"], t["path"], t["data_type"]).cast("double")
    else:
        c = table.column(node["column"])
        if c.kind not in ("integer", "unsigned", "real"):
            raise RequestError(f"no histogram of the {c.kind} column {c.name}")
        value = F.col(c.name).cast("double")
    width, offset = float(node["interval"]), float(node.get("offset") or 0)
    if not 0 < width < float("inf"):
        raise RequestError("an interval is finite and above 0")
    bounds = lambda b: (float(b["min"]), float(b["max"])) if b else None
    return _spaced(df, keys, name, value, width, offset, node, bounds, extra, lambda s: s * F.lit(width) + F.lit(offset))


def date_histogram(table: Table, df: DataFrame, keys: list[str], name: str, node: dict, extra: list[Column | Percentile]) -> tuple[DataFrame, DataFrame]:
    import datetime as dt

    width, offset = duration(node["fixed_interval"]), duration(node["offset"]) if node.get("offset") else 0
    if width <= 0:
        raise RequestError("an interval is above 0")

    def moment(v) -> int:
        if isinstance(v, (int, float)):
            return int(v) * 1000  # milliseconds
        t = dt.datetime.fromisoformat(v)
        return round((t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)).timestamp() * 1_000_000)

    bounds = lambda b: (moment(b["min"]), moment(b["max"])) if b else None
    return _spaced(df, keys, name, micros(table, node["column"]), width, offset, node, bounds, extra, lambda s: F.timestamp_micros(s * F.lit(width) + F.lit(offset)))


def ranges(table: Table, df: DataFrame, keys: list[str], name: str, node: dict, extra: list[Column | Percentile]) -> tuple[DataFrame, DataFrame]:
    """The given ranges, from inclusive to exclusive, empty ones too; a value counts in each range that holds it."""
    if not 1 <= len(node["ranges"]) <= 1000 or (node.get("keyed") and not all(r.get("key") for r in node["ranges"])):
        raise RequestError("1 to 1000 ranges, with keys if keyed")
    if node["kind"] == "json_range":
        t = node["target"]
        if t["data_type"] not in json_path.NUMERIC:
            raise RequestError("a range's JSON path is numeric")
        value, lit = json_path.typed(table, t["column"], t["path"], t["data_type"]), F.lit
    else:
        c = table.column(node["column"])
        value, lit = F.col(c.name), lambda v: literal(c, v)
    key = f"{name}_key"
    label = lambda r: r.get("key") or f"{'*' if r.get('from') is None else r['from']}-{'*' if r.get('to') is None else r['to']}"
    inside = [reduce(lambda a, b: a & b, [x for x in (value >= lit(r["from"]) if r.get("from") is not None else None, value < lit(r["to"]) if r.get("to") is not None else None) if x is not None], value.isNotNull()) for r in node["ranges"]]
    labels = F.filter(F.array(*[F.when(p, F.lit(label(r))) for r, p in zip(node["ranges"], inside)]), lambda x: x.isNotNull())
    members = df.withColumn(key, F.explode(labels))
    own = _grouped(members, [*keys, key], extra)
    every = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = every.withColumn(key, F.explode(F.array(*[F.lit(label(r)) for r in node["ranges"]])))
    own = _join(grid, own, [*keys, key], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long")))
    return members, own


def filter_bucket(table: Table, df: DataFrame, keys: list[str], name: str, node: dict, extra: list[Column | Percentile]) -> tuple[DataFrame, DataFrame]:
    members = df.where(Lowering(table, scored=False).where(node["filter"]))
    return members, _grouped(members, keys, extra)


def composite(table: Table, df: DataFrame, keys: list[str], name: str, node: dict, extra: list[Column | Percentile]) -> tuple[DataFrame, DataFrame]:
    """Buckets of key tuples in tuple order, a page at a time: `after` takes the last tuple of the page before."""
    sources, size = node["sources"], node.get("size", 10)
    if not 1 <= len(sources) <= 16 or not 1 <= size <= MAX_SIZE:
        raise RequestError("1 to 16 sources and a size of 1 to 10000")
    by, names = [], []
    for s in sources:
        key = f"{s['name']}_key"
        df = df.withColumn(key, _source(table, s))
        if not s.get("missing_bucket"):
            df = df.where(F.col(key).isNotNull())
        down, missing = s.get("descending", False), s.get("missing_order", "default")
        first = missing == "first" or (missing == "default" and not down)
        names.append((key, down, first))
        c = F.col(key)
        by.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    grouped = _grouped(df, [*keys, *[n for n, _, _ in names]], extra)
    if node.get("after"):
        grouped = grouped.where(_beyond(grouped, names, [node["after"][s["name"]] for s in sources]))
    if not keys:
        return df, grouped.orderBy(*by).limit(size)
    ranked = grouped.withColumn("__qm_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return df, ranked.where(F.col("__qm_r") <= size).drop("__qm_r")


def _source(table: Table, s: dict) -> Column:
    kind = s.get("kind", "terms")
    if kind == "json_terms":
        t = s["target"]
        return json_path.typed(table, t["column"], t["path"], t["data_type"])
    c = table.column(s["column"])
    if kind == "terms":
        return F.col(c.name)
    if kind == "histogram":
        width = float(s["interval"])
        if not width > 0:
            raise RequestError("an interval is above 0")
        return F.floor(F.col(c.name).cast("double") / F.lit(width)) * F.lit(width)
    if kind == "date_histogram":
        if (s.get("fixed_interval") is None) == (s.get("calendar_interval") is None):
            raise RequestError("a date source has a fixed or a calendar interval")
        m = micros(table, s["column"])
        if s.get("calendar_interval"):
            if s["calendar_interval"] not in EPOCH_WEEK:
                raise RequestError(f"unknown calendar interval {s['calendar_interval']}")
            return F.date_trunc(EPOCH_WEEK[s["calendar_interval"]], F.timestamp_micros(m))
        width = F.lit(duration(s["fixed_interval"]))
        return F.timestamp_micros(F.floor(m / width).cast("long") * width)
    raise RequestError(f"unknown source {kind}")


def _beyond(df: DataFrame, names: list[tuple[str, bool, bool]], values: list) -> Column:
    out, same = F.lit(False), F.lit(True)
    kinds = dict(df.dtypes)
    for (key, down, nulls_first), v in zip(names, values):
        c = F.col(key)
        if v is None:
            past = c.isNotNull() if nulls_first else F.lit(False)
            equal = c.isNull()
        else:
            v = F.lit(v).cast(kinds[key])
            past = F.coalesce(c < v if down else c > v, F.lit(not nulls_first))
            equal = F.coalesce(c == v, F.lit(False))
        out, same = out | (same & past), same & equal
    return out


def after_key(page: DataFrame, sources: list[dict]) -> dict | None:
    """The `after` value that continues a composite page (of its size at most), None for an empty page."""
    rows = page.collect()
    return {s["name"]: rows[-1][f"{s['name']}_key"] for s in sources} if rows else None


def top_hits(table: Table, df: DataFrame, keys: list[str], node: dict, depth: int) -> DataFrame:
    if depth == 1 or not 1 <= node["size"] <= 100:
        raise RequestError("top_hits stands below a bucket, with a size of 1 to 100")
    by = []
    for s in node.get("sort", []):
        if s.get("geo_distance_from"):
            raise RequestError("top_hits do not sort by distance")
        c = F.col(table.column(s["column"]).name)
        by.append(c.desc_nulls_last() if s.get("descending") else c.asc_nulls_last())
    by.append(F.col(table.key))
    if not keys:  # one bucket: its first rows are found in all tasks, and only they are ranked in one
        df = df.orderBy(*by).limit(node["size"])
    rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*by))
    columns = [table.column(c).name for c in node.get("columns", [])] or list(table.columns)
    return df.withColumn("rank", rank).where(F.col("rank") <= node["size"]).select(*keys, "rank", *columns)


def geo_tile_grid(table: Table, df: DataFrame, node: dict) -> DataFrame:
    """Map tiles in Morton order with their documents or points; more tiles than max_buckets are an error."""
    c, zoom, most = table.column(node["column"]), node["zoom"], node.get("max_buckets", 10_000)
    if c.scalar != "geo_point" or not 0 <= zoom <= 31 or not 1 <= most <= 100_000:
        raise RequestError("geo_tile_grid takes a geographic column, a zoom of 0 to 31 and 1 to 100000 buckets")
    points = F.col(c.name) if c.is_array else F.array(c.name)
    points = F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    if node.get("bounds"):
        box = geo.checked_bounds(node["bounds"])
        points = F.filter(points, lambda p: geo.in_box(p, *box))

    def tile(p: Column) -> Column:
        x, y = geo.tile_xy(p, zoom)
        return F.struct(x.alias("x"), y.alias("y"))

    tiles = F.transform(points, tile)
    if node.get("count_mode", "documents") == "documents":
        tiles = F.array_distinct(tiles)
    counted = df.select(F.explode(tiles).alias("t")).groupBy("t.x", "t.y").agg(F.count(F.lit(1)).alias("doc_count"))
    if counted.limit(most + 1).count() > most:
        raise RequestError(f"more than {most} tiles")
    spread = [sum((F.shiftleft(F.shiftright(F.col(a), b).bitwiseAND(F.lit(1)), 2 * b + s) for b in range(zoom)), F.lit(0).cast("long")) for a, s in (("x", 0), ("y", 1))]
    return counted.orderBy(spread[0].bitwiseOR(spread[1])).select(F.lit(zoom).alias("z"), "x", "y", "doc_count")


RULES = {
    "terms": terms, "json_terms": json_terms, "histogram": histogram, "json_histogram": histogram, "date_histogram": date_histogram,
    "range": ranges, "json_range": ranges, "filter": filter_bucket, "composite": composite,
}


def nested(table: Table, request: dict[str, dict], filter_: dict | None = None) -> dict:
    """The whole answer as nested dicts: buckets with their metrics and the aggregations below them.

    Collects the frames of aggregate(), whose sizes the requests bound; histograms are bounded by max_buckets here.
    """
    frames = {p: [r.asDict() for r in df.limit(MAX_SIZE + 1).collect()] for p, df in aggregate(table, request, filter_).items()}
    for p, rows in frames.items():
        if len(rows) > MAX_SIZE:
            raise RequestError(f"{p} has more than {MAX_SIZE} buckets")
    return {name: _render(frames, name, node, {}) for name, node in request.items()}


def _render(frames: dict[str, list[dict]], path: str, node: dict, above: dict):
    rows = [r for r in frames[path] if all(r.get(k) == v for k, v in above.items())]
    plain = lambda r: {k: v for k, v in r.items() if k not in above}
    if node["kind"] == "metric":
        return plain(rows[0]) if rows else None
    if node["kind"] in ("top_hits", "geo_tile_grid"):
        return {"hits" if node["kind"] == "top_hits" else "buckets": [plain(r) for r in rows]}
    below = {n: c for n, c in node.get("aggregations", {}).items() if c["kind"] != "metric"}
    buckets = []
    for r in rows:
        own = above | {k: v for k, v in r.items() if k.endswith("_key")}
        buckets.append(plain(r) | {n: _render(frames, f"{path}.{n}", c, own) for n, c in below.items()})
    if node["kind"] == "filter":
        return buckets[0] if buckets else {"doc_count": 0}
    if node.get("keyed"):
        key = f"{path.rsplit('.', 1)[-1]}_key"
        return {"buckets": {str(b[key]): b for b in buckets}}
    return {"buckets": buckets}


def profile(table: Table, request: dict[str, dict], filter_: dict | None = None) -> dict[str, dict]:
    """{path: seconds to plan and to run a node, and its rows}; every node is run by itself."""
    began, out = time.perf_counter(), {}
    for path, df in aggregate(table, request, filter_).items():
        df._jdf.queryExecution().executedPlan()
        planned = time.perf_counter()
        rows = df.count()
        out[path] = {"plan_seconds": planned - began, "run_seconds": time.perf_counter() - planned, "rows": rows}
        began = time.perf_counter()
    return out


# partial results of distributed parts


def partial_terms(table: Table, column: str, metric: str | None = None) -> DataFrame:
    """A part's mergeable state for terms with count, sum, min, max and a distinct sketch of a metric column."""
    c = table.column(column)
    m = F.col(table.column(metric).name) if metric else F.lit(None).cast("double")
    return table.df.where(F.col(c.name).isNotNull()).groupBy(F.col(c.name).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(m).cast("double").alias("sum"), F.min(m).cast("double").alias("min"), F.max(m).cast("double").alias("max"), F.count(m).alias("values"), F.hll_sketch_agg(m.cast("string")).alias("sketch")
    )


def merge_terms(parts: list[DataFrame]) -> DataFrame:
    """The final terms of several parts, as if one pass had seen all rows."""
    if not 1 <= len(parts) <= 1024:
        raise RequestError("1 to 1024 parts")
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("key").agg(
        F.sum("n").alias("doc_count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), (F.sum("sum") / F.sum("values")).alias("average"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cardinality")
    )
