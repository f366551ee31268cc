"""Reads against plain Python over the fixtures' rows."""

import pytest

from querymill.operators import buckets, reads
from querymill.plans.filters import Lowering, without_own
from querymill.table import RequestError, Table

from .fixtures import BUOYS, DEGREE, LISTS, LOGS, SEEDS, buoys, lists, logs, seeds

SKU, NAME, BED, GRAMS, ORGANIC, PACKED, REMARK = range(7)


def cmp(column, op, value):
    return {"kind": "compare", "column": column, "operator": op, "value": value}


def text(query, *fields):
    return {"kind": "search", "fields": list(fields), "query": query}


def found(t, f, **more):
    """Keys in the order of the answer."""
    request = {"filter": f, "projection": [{"kind": "column", "column": t.key}], "order_by": [{"column": t.key}], **more}
    return [r[0] for r in reads.read(t, request).collect()]


def skus(rule):
    return [r[SKU] for r in SEEDS if rule(r)]


def test_structural_filters_equal_python(spark):
    t = seeds(spark)
    cases = [
        (cmp("grams", "less", 6), lambda r: r[GRAMS] < 6), (cmp("remark", "not_equal", "hardy"), lambda r: r[REMARK] != "hardy"), (cmp("organic", "equal", True), lambda r: r[ORGANIC]),
        ({"kind": "between", "column": "grams", "lower": 4.5, "upper": 12}, lambda r: 4.5 <= r[GRAMS] <= 12), ({"kind": "is_null", "column": "remark", "negated": False}, lambda r: r[REMARK] is None),
        ({"kind": "in", "column": "sku", "values": [13, 13, 21, *range(500, 700)]}, lambda r: r[SKU] in (13, 21)), ({"kind": "in", "column": "sku", "values": [20, *range(100, 12_000)]}, lambda r: r[SKU] == 20),
        (cmp("packed", "greater", "2025-03-05T08:30:00+02:00"), lambda r: r[PACKED].day > 5), (cmp("packed", "greater_or_equal", "2025-03-05T08:30:00+02:00"), lambda r: r[PACKED].day >= 5),
        (text("climb beans OR hardy"), lambda r: "Climbing" in r[NAME] or "beans" in r[NAME] or r[REMARK] == "hardy"),
    ]
    for f, rule in cases:
        assert found(t, f) == skus(rule), f
        assert found(t, {"kind": "not", "filter": f}) == skus(lambda r: not rule(r)), f


def test_words_phrases_and_patterns(spark):
    t = seeds(spark)
    cases = [
        (text("tomato", "name"), lambda r: "tomatoes" in r[NAME]), (text('"dwarf bean"', "name"), lambda r: r[NAME] == "Dwarf beans"), (text("+roses -early"), lambda r: "roses" in r[NAME] and "Early" not in r[NAME]),
        (text("bed:glass AND NOT dwarf"), lambda r: r[BED] == "glass" and "Dwarf" not in r[NAME]), ({"kind": "phrase_prefix", "column": "name", "phrase": "early to"}, lambda r: r[NAME] == "Early tomatoes"),
        ({"kind": "fuzzy", "column": "name", "value": "rosse", "distance": 1, "transposition_cost_one": True}, lambda r: "roses" in r[NAME]), ({"kind": "prefix", "column": "name", "value": "squ"}, lambda r: "squashes" in r[NAME]),
        ({"kind": "regex_phrase", "column": "name", "patterns": ["(dwarf|earli)", "b.*"]}, lambda r: r[NAME] in ("Dwarf beans", "Early beans")),
    ]
    for f, rule in cases:
        assert found(t, f) == skus(rule), f
    assert found(t.with_tokens("name"), cases[0][0]) == skus(cases[0][1])
    for bad in (text(""), text("("), text("OR x"), text("-x"), text("b ("), {"kind": "regex", "column": "name", "pattern": "["}):
        with pytest.raises(RequestError):
            found(t, bad)


def test_order_offset_and_cursor(spark):
    for parts in (1, 4):
        t = seeds(spark, parts)
        down = [r[SKU] for r in sorted(SEEDS, key=lambda r: (r[REMARK] is not None, [-ord(c) for c in r[REMARK] or ""], r[SKU]))]  # nulls first
        up = [r[SKU] for r in sorted(SEEDS, key=lambda r: (r[REMARK] is None, r[REMARK] or "", r[SKU]))]  # nulls last
        assert found(t, None, order_by=[{"column": "remark"}]) == up and found(t, None, order_by=[{"column": "remark", "descending": True}]) == down
        assert found(t, None, order_by=[{"column": "remark"}], offset=3, limit=4) == up[3:7]
        seen, after = [], None
        while True:
            page = reads.read_page(t, {"projection": [{"kind": "column", "column": "sku"}], "order_by": [{"column": "bed"}], "limit": 5, "search_after": after})
            seen += [r[0] for r in page.df.collect()]
            if (after := page.next_search_after) is None:
                break
        assert seen == [r[SKU] for r in sorted(SEEDS, key=lambda r: (r[BED], r[SKU]))]
        with pytest.raises(RequestError):  # a cursor holds values
            reads.read_page(t, {"order_by": [{"column": "remark"}], "search_after": [None, 15]})


def test_requests_that_do_not_fit_are_refused(spark):
    t = seeds(spark)
    for f in (cmp("grams", "equal", "heavy"), cmp("sku", "equal", 1.5), cmp("organic", "equal", 0), cmp("packed", "less", "2025-03-01T00:00:00"), cmp("weight", "equal", 1), {"kind": "in", "column": "sku", "values": []}, {"kind": "any", "filters": []}, {"kind": "like"}):
        with pytest.raises(RequestError):
            Lowering(t, scored=False).lower(f)
    for table, column in ((lists(spark), "marks"), (t, "weight")):
        with pytest.raises(RequestError):
            reads.read(table, {"order_by": [{"column": column}]})


def test_any_element_of_an_array(spark):
    t = lists(spark)
    assert found(t, cmp("sizes", "equal", 4)) == [i for i, _, s in LISTS if s and 4 in s]
    assert found(t, cmp("sizes", "not_equal", 4)) == [i for i, _, s in LISTS if not s or 4 not in s]
    assert found(t, {"kind": "is_null", "column": "marks", "negated": False}) == [4]


def scored(t, f, **more):
    return reads.read(t, {"projection": [{"kind": "column", "column": t.key}, {"kind": "score"}], "filter": f, "limit": 100, **more}).collect()


def test_scores(spark):
    t = seeds(spark)
    assert {r["_score"] for r in scored(t, cmp("bed", "equal", "glass"))} == {0.0}
    rows = scored(t, text("dwarf roses", "name"))
    assert rows[0][0] == next(r[SKU] for r in SEEDS if r[NAME] == "Dwarf roses") and rows == sorted(rows, key=lambda r: (-r["_score"], r[0]))
    alone = {r[0]: r["_score"] for r in scored(t, text("dwarf"))}
    both = {r[0]: r["_score"] for r in scored(t, {"kind": "all", "filters": [text("dwarf"), cmp("grams", "less", 9)]})}
    assert both and all(alone[k] == s for k, s in both.items())
    (top,) = [r for r in reads.explain_score(t, text("dwarf roses", "name"), rows[0][0]).groupBy().agg({"score": "sum", "total": "max"}).collect()]
    assert abs(top[0] - top[1]) < 1e-12
    with pytest.raises(RequestError):
        reads.explain_score(t, text("dwarf", "name"), next(r[SKU] for r in SEEDS if "Early" in r[NAME]))
    pair = Table.of(spark.createDataFrame([(1, "fern", "fern"), (2, "fern", "moss")], "id long, a string, b string"), "id")
    best = lambda tie: {r[0]: r["_score"] for r in scored(pair, {"kind": "disjunction_max", "fields": {"a": 1.0, "b": 1.0}, "query": "fern", "tie_breaker": tie})}
    assert best(0.25)[1] > best(0.0)[1] and best(0.25)[2] == best(0.0)[2]


def test_highlight(spark):
    rows = reads.read(seeds(spark), {"projection": [{"kind": "highlight", "column": "name", "alias": "mark"}], "filter": text("squash", "name"), "order_by": [{"column": "sku"}]}).collect()
    assert [r["mark"] for r in rows] == [r[NAME].replace("squashes", "<b>squashes</b>") for r in SEEDS if "squashes" in r[NAME]]


def test_json(spark):
    t = logs(spark)
    path = lambda kind, name, data_type, **more: {"kind": kind, "column": "body", "path": name, "data_type": data_type, **more}
    assert found(t, path("json_between", "ms", "i64", lower=10, upper=50)) == [k for k, r in enumerate(LOGS) if 10 <= r["ms"] <= 50]
    assert found(t, {"kind": "json_exists", "column": "body", "path": "load"}) == [k for k, r in enumerate(LOGS) if "load" in r]
    assert found(t, path("json_compare", "on", "date_time", operator="greater", value="2025-05-02T00:00:00Z")) == [k for k, r in enumerate(LOGS) if r.get("on", "") > "2025-05-02"]
    assert found(t, {"kind": "json_search", "column": "body", "path": "level", "query": "INFO"}) == [k for k, r in enumerate(LOGS) if r.get("level") == "info"]
    assert found(t, None, order_by=[{"column": "body", "json_path": "ms", "json_type": "i64"}]) == sorted(range(len(LOGS)), key=lambda k: LOGS[k]["ms"])
    with pytest.raises(RequestError):
        found(t, path("json_compare", "ms", "string", operator="equal", value="7"))


def test_geography(spark):
    t = buoys(spark)
    point = lambda lat, lon: {"lat": lat, "lon": lon}
    near = lambda c, lat, lon, r: found(t, {"kind": "geo_distance", "column": c, "center": point(lat, lon), "radius_meters": r})
    assert near("at", 0, 40, 0) == [1] and near("at", 0, 40, 1.01 * DEGREE) == [1, 2] and near("at", 0, 40, 0.99 * DEGREE) == [1]
    assert near("track", 1, 40, 10) == [1, 2]
    assert near("at", -30, 180, DEGREE) == [3, 4]  # across the date line
    assert near("at", 88, -170, 4.01 * DEGREE) == [5]  # across the pole
    assert near("at", 0, 0, 181 * DEGREE) == [i for i, at, _ in BUOYS if at]
    assert found(t, {"kind": "geo_bounding_box", "column": "at", "bounds": {"top_left": point(-20, 179), "bottom_right": point(-40, -179)}}) == [3, 4]
    far = found(t, {"kind": "in", "column": "id", "values": [1, 2]}, order_by=[{"column": "track", "geo_distance_from": point(0, 40), "geo_distance_mode": "min"}])
    assert far == [1, 2]
    d = reads.read(t, {"projection": [{"kind": "geo_distance", "column": "at", "from": point(0, 40)}], "filter": cmp("id", "equal", 2)}).first()[0]
    assert abs(d - DEGREE) < 1


def test_own_filter_goes():
    mine, rest = cmp("bed", "equal", "field"), cmp("grams", "less", 5)
    assert without_own({"kind": "all", "filters": [rest, mine]}, "BED") == {"kind": "all", "filters": [rest]}
    assert without_own({"kind": "any", "filters": [{"kind": "not", "filter": mine}]}, "bed") is None


def test_plans_profiles_and_row_lists(spark):
    t = seeds(spark)
    assert reads.explain(t, {"order_by": [{"column": "grams"}], "limit": 3}).startswith("top-k")
    stored = Table.of(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), "p_partkey")
    assert "PushedFilters" in reads.explain(stored, {"filter": cmp("p_size", "greater", 5)})
    assert reads.profile(t, {"limit": 5})["rows"] == 5
    spent = buckets.profile(t, {"all": {"kind": "metric", "function": "count"}})
    assert spent["all"]["rows"] == 1 and spent["all"]["run_seconds"] > 0
    assert [r["sku"] for r in reads.list_rows(t, q="hardy beans").collect()] == skus(lambda r: "beans" in r[NAME] or r[REMARK] == "hardy")
    with pytest.raises(RequestError):
        reads.list_rows(t, limit=0)
