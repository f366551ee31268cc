"""Groups, buckets, facets and similar rows against plain Python over the fixtures' rows."""

import math
from collections import Counter, defaultdict

import pytest

from querymill.operators import buckets, facets, reads, similar
from querymill.table import RequestError, Table

from .fixtures import LOGS, SEEDS, SHELVES, buoys, logs, seeds, shelves

SKU, NAME, BED, GRAMS, ORGANIC, PACKED, REMARK = range(7)


def agg(function, column=None, alias=None):
    return {"kind": "aggregate", "function": function, "column": column, "alias": alias or function}


def grouped(t, keys, aggs, **more):
    return [tuple(r) for r in reads.read(t, {"projection": [{"kind": "column", "column": k} for k in keys] + aggs, "group_by": keys, **more}).collect()]


def by(column, rows=SEEDS):
    out = defaultdict(list)
    for r in rows:
        out[r[column]].append(r)
    return out


def test_groups(spark):
    t = seeds(spark)
    want = [(k, len(rows), sum(r[GRAMS] for r in rows) / len(rows)) for k, rows in by(BED).items()]
    assert grouped(t, ["bed"], [agg("count"), agg("average", "grams")]) == sorted(want, key=lambda x: (-x[1], x[0]))
    assert grouped(t, ["bed"], [agg("count"), agg("average", "grams", "mean")], order_by=[{"column": "mean"}], limit=2) == sorted(want, key=lambda x: x[2])[:2]
    assert set(grouped(t, ["remark"], [agg("count")])) == set(Counter(r[REMARK] for r in SEEDS).items())
    assert grouped(t, [], [agg("count", None, "n"), agg("count", "remark", "m")]) == [(12, sum(r[REMARK] is not None for r in SEEDS))]
    assert grouped(t, [], [agg("count")], offset=2) == []
    for bad in ([agg("min", "name")], [agg("average", "packed")], []):
        with pytest.raises(RequestError):
            grouped(t, ["bed"], bad)
    assert len(grouped(t, ["sku"], [agg("count")], max_groups=12)) == 12
    with pytest.raises(RequestError):
        grouped(t, ["sku"], [agg("count")], max_groups=11)


def test_json_buckets(spark):
    target = lambda path, kind: {"column": "body", "path": path, "data_type": kind}
    got = buckets.nested(logs(spark), {
        "mean": {"kind": "metric", "function": "average", "json_path": target("load", "f64"), "missing": 1},
        "good": {"kind": "filter", "filter": {"kind": "json_compare", **target("ok", "bool"), "operator": "equal", "value": True}},
        "level": {"kind": "json_terms", "target": target("level", "string"), "missing": "-"},
    })
    assert got["mean"]["value"] == sum(r.get("load", 1) for r in LOGS) / len(LOGS) and got["good"]["doc_count"] == sum(r["ok"] for r in LOGS)
    assert {b["level_key"]: b["doc_count"] for b in got["level"]["buckets"]} == Counter(r.get("level", "-") for r in LOGS)


@pytest.mark.parametrize("parts", [1, 5])
def test_trees_do_not_depend_on_partitions(spark, parts):
    request = {
        "beds": {"kind": "terms", "column": "bed", "aggregations": {"light": {"kind": "top_hits", "size": 2, "sort": [{"column": "grams"}], "columns": ["sku"]}, "g": {"kind": "metric", "function": "stats", "column": "grams"}}},
        "sizes": {"kind": "range", "column": "grams", "keyed": True, "ranges": [{"key": "s", "to": 5}, {"key": "m", "from": 5, "to": 10}, {"key": "none", "from": 1000}]},
    }
    rows = [r for r in SEEDS if r[SKU] >= 12]
    got = buckets.nested(seeds(spark, parts), request, {"kind": "compare", "column": "sku", "operator": "greater_or_equal", "value": 12})
    assert [(b["beds_key"], b["doc_count"]) for b in got["beds"]["buckets"]] == sorted(((k, len(x)) for k, x in by(BED, rows).items()), key=lambda x: (-x[1], x[0]))
    for b in got["beds"]["buckets"]:
        mine = by(BED, rows)[b["beds_key"]]
        assert b["g_max"] == max(r[GRAMS] for r in mine) and [h["sku"] for h in b["light"]["hits"]] == [r[SKU] for r in sorted(mine, key=lambda r: r[GRAMS])[:2]]
    assert {k: b["doc_count"] for k, b in got["sizes"]["buckets"].items()} == {"s": sum(r[GRAMS] < 5 for r in rows), "m": sum(5 <= r[GRAMS] < 10 for r in rows), "none": 0}


def test_composite_pages_and_children_of_missing_values(spark):
    t = seeds(spark)
    sources = [{"kind": "terms", "name": "remark", "column": "remark", "missing_bucket": True}, {"kind": "terms", "name": "bed", "column": "bed", "descending": True}]
    seen, after = [], None
    while True:
        page = buckets.aggregate(t, {"b": {"kind": "composite", "sources": sources, "size": 2, "after": after}})["b"]
        if not (rows := page.collect()):
            break
        seen += [(r["remark_key"], r["bed_key"], r["doc_count"]) for r in rows]
        after = buckets.after_key(page, sources)
    want = Counter((r[REMARK], r[BED]) for r in SEEDS)
    assert [x[:2] for x in seen] == sorted(want, key=lambda x: (x[0] is not None, x[0] or "", [-ord(c) for c in x[1]])) and all(want[x[:2]] == x[2] for x in seen)
    for child in ({"kind": "terms", "column": "bed"}, {"kind": "histogram", "column": "grams", "interval": 4}, {"kind": "range", "column": "grams", "ranges": [{"to": 8}, {"from": 8}]}):
        kids = buckets.aggregate(t, {"b": {"kind": "composite", "sources": sources[:1], "aggregations": {"kids": child}}})["b.kids"].collect()
        totals = Counter()
        for r in kids:
            totals[r["remark_key"]] += r["doc_count"]
        assert totals == Counter(r[REMARK] for r in SEEDS), child


def test_guards(spark):
    t = seeds(spark)
    deep = {"kind": "terms", "column": "bed"}
    for _ in range(4):
        deep = {"kind": "terms", "column": "bed", "aggregations": {"below": deep}}
    for bad in (deep, {"kind": "top_hits", "size": 3}, {"kind": "histogram", "column": "grams", "interval": -1}, {"kind": "histogram", "column": "name", "interval": 2}, {"kind": "terms", "column": "bed", "size": 0}, {"kind": "metric", "function": "max"}, {"kind": "date_histogram", "column": "packed", "fixed_interval": "2y"}, {"kind": "composite", "sources": []}):
        with pytest.raises(RequestError):
            buckets.aggregate(t, {"a": bad})
    with pytest.raises(Exception, match="buckets"):
        buckets.aggregate(t, {"a": {"kind": "histogram", "column": "grams", "interval": 1e-6}})["a"].collect()
    assert buckets.aggregate(t, {"a": {"kind": "terms", "column": "bed"}}, max_buckets=3)["a"].count() == 3
    with pytest.raises(RequestError):
        buckets.aggregate(t, {"a": {"kind": "terms", "column": "bed"}}, max_buckets=2)


def test_hits_below_one_filter_and_exact_metrics(spark):
    node = {"kind": "filter", "filter": {"kind": "compare", "column": "bed", "operator": "equal", "value": "field"}, "aggregations": {"hits": {"kind": "top_hits", "size": 2, "sort": [{"column": "grams", "descending": True}], "columns": ["sku"]}}}
    rows = buckets.aggregate(seeds(spark), {"f": node})["f.hits"].collect()
    assert [(r["rank"], r["sku"]) for r in rows] == [(k + 1, r[SKU]) for k, r in enumerate(sorted((r for r in SEEDS if r[BED] == "field"), key=lambda r: -r[GRAMS])[:2])]
    metric = {"kind": "metric", "exact": True}
    got = buckets.nested(seeds(spark), {"n": {**metric, "function": "cardinality", "column": "bed"}, "p": {**metric, "function": "percentiles", "column": "grams", "percents": [50]}})
    grams = sorted(r[GRAMS] for r in SEEDS)
    assert got["n"]["value"] == 3 and got["p"]["p50"] == (grams[5] + grams[6]) / 2


def to_one_task(df):
    """Bytes that a frame's run, which has ended, sent into single partitions."""
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec" and "SinglePartition" in node.outputPartitioning().toString():
            total += node.metrics().apply("dataSize").value()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        left += below + [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_exact_percentiles_are_not_found_in_one_task(spark):
    share = lambda p, v: v[int(p * (len(v) - 1))] + p * (len(v) - 1) % 1 * (v[min(int(p * (len(v) - 1)) + 1, len(v) - 1)] - v[int(p * (len(v) - 1))])
    df = spark.range(100_000, numPartitions=4).selectExpr("id", "IF(id % 7 = 0, NULL, id * 7919 % 100003 / 4 - 9000) AS v", "IF(id % 5 = 0, NULL, id % 5) AS g")
    t = Table.of(df, "id")
    node = {"kind": "metric", "function": "percentiles", "column": "v", "exact": True, "percents": [0, 12.5, 50, 100]}
    values = defaultdict(list)
    for k in range(100_000):
        if k % 7:
            values[k % 5 or None].append(k * 7919 % 100003 / 4 - 9000)
    got = buckets.aggregate(t, {"p": node})["p"]
    every = sorted(x for v in values.values() for x in v)
    assert got.collect()[0].asDict() == pytest.approx({"p0": every[0], "p12_5": share(0.125, every), "p50": share(0.5, every), "p100": every[-1]}, abs=1e-9)
    assert to_one_task(got) < 100_000
    sources = [{"kind": "terms", "name": "g", "column": "g", "missing_bucket": True}]
    rows = buckets.aggregate(t, {"b": {"kind": "composite", "sources": sources, "aggregations": {"p": node, "n": {"kind": "metric", "function": "count", "column": "v"}}}})["b"].collect()
    assert {r["g_key"]: (r["p_p12_5"], r["n"]) for r in rows} == {g: (pytest.approx(share(0.125, sorted(v)), abs=1e-9), len(v)) for g, v in values.items()}
    none = buckets.aggregate(t, {"p": node}, {"kind": "compare", "column": "id", "operator": "less", "value": 0})["p"]
    assert list(map(tuple, none.collect())) == [(None,) * 4]


def test_percentiles_order_all_doubles(spark):
    ends = [math.ldexp(1.0, e) for e in (-1074, -1023, -1022, -1, 0, 29, 1023)]
    values = sorted({s * x for v in ends for x in (v, math.nextafter(v, 0), math.nextafter(v, 2 * v)) for s in (1, -1)} | {math.inf, -math.inf})
    rows = [(k, v) for k, v in enumerate([*values, math.nan])]
    bits = [b for _, _, b in sorted(buckets._sortable(spark.createDataFrame(rows, "k long, v double"), "v", "b").collect())]
    assert bits == sorted(set(bits))


def test_facets(spark):
    t = shelves(spark)
    pots, held = ({"kind": "compare", "column": c, "operator": "equal", "value": v} for c, v in (("place", "/shop/pots"), ("stock", "in")))
    got = lambda **k: {r["path"]: r["doc_count"] for r in facets.facets(t, "place", "/shop", **k).collect()}
    count = lambda rule: Counter("/".join(p.split("/")[:3]) for i, p, s in SHELVES if rule(p, s))
    both = {"kind": "all", "filters": [pots, held]}
    assert got(filter_=both) == count(lambda p, s: s == "in" and "/pots" in p)
    assert got(filter_=both, exclude_own_filter=True) == count(lambda p, s: s == "in")


def test_tiles(spark):
    count = lambda n, f=None: [r["doc_count"] for r in buckets.aggregate(buoys(spark), {"g": {"kind": "geo_tile_grid", "column": "track", **n}}, f)["g"].collect()]
    assert count({"zoom": 0}) == [5] and count({"zoom": 0, "count_mode": "points"}) == [7]
    box = {"top_left": {"lat": 0.5, "lon": 30}, "bottom_right": {"lat": -0.5, "lon": 50}}
    assert count({"zoom": 0, "count_mode": "points", "bounds": box}) == [2]
    with pytest.raises(RequestError):
        count({"zoom": 31, "max_buckets": 2})


def test_merged_parts_equal_one_pass(spark):
    t = seeds(spark)
    parts = [buckets.partial_terms(t.with_df(t.df.where(f"sku % 3 = {k}")), "bed", "grams") for k in range(3)]
    assert sorted(map(tuple, buckets.merge_terms(parts).collect())) == sorted(map(tuple, buckets.merge_terms([buckets.partial_terms(t, "bed", "grams")]).collect()))


def test_more_like_this(spark):
    t = seeds(spark)
    first = SEEDS[0]
    rows = similar.more_like_this(t, first[SKU], ["name"], {"kind": "compare", "column": "bed", "operator": "equal", "value": first[BED]}, min_term_frequency=1).collect()
    alike = {r[SKU] for r in SEEDS[1:] if r[BED] == first[BED] and set(r[NAME].split()) & set(first[NAME].split())}
    assert {r["sku"] for r in rows} == alike and all(r["_score"] > 0 for r in rows)
    assert similar.more_like_this(t, 999, ["name"]).count() == 0
