"""One registered query per operator of the engine, over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators import buckets, catalog, facets, reads, similar
from querymill.plans.filters import Lowering
from querymill.table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALL = 1 << 30


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# tables


def _load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> Table:
    return Table.of(_load(spark, d, "events"), "event_id", "events", {"props": "json"}, {"event_type": "raw"})


def lineitem(spark: SparkSession, d: str) -> Table:
    df = _load(spark, d, "lineitem")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return Table.of(df.withColumn("line", key), "line", "lineitem", analyzers={"l_returnflag": "raw", "l_linestatus": "raw", "line": "raw"})


def orders(spark: SparkSession, d: str) -> Table:
    """orders with a priority that is null for some rows."""
    df = _load(spark, d, "orders").withColumn("priority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return Table.of(df, "o_orderkey", "orders", analyzers={"priority": "raw", "o_orderstatus": "raw", "o_orderpriority": "raw"})


ORDERS = "(SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders) o"


def parts(spark: SparkSession, d: str) -> Table:
    df = _load(spark, d, "part").withColumn("words", F.split("p_name", " ")).withColumn("path", F.concat(F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_brand")))
    return Table.of(df, "p_partkey", "part", {"path": "facet"}, {"words": "raw", "p_brand": "raw", "p_type": "raw"})


PARTS = "(SELECT *, string_split(p_name, ' ') AS words, '/' || replace(p_type, ' ', '/') || '/' || p_brand AS path FROM part) p"


def documents(spark: SparkSession, d: str) -> Table:
    return Table.of(_load(spark, d, "documents"), "doc_id", "documents", analyzers={"lang": "raw", "source": "raw"})


DOCS = "(SELECT *, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: strlen(t) < 40) AS toks FROM documents) d"


def places(spark: SparkSession, d: str) -> Table:
    """Customers at made-up points, some without, and with one or two more points in an array."""
    df = _load(spark, d, "customer")
    lat, lon = ((F.col("c_custkey") * 7919) % 17000) / 100.0 - 85, ((F.col("c_custkey") * 104729) % 36000) / 100.0 - 180
    point = F.struct(lat.alias("lat"), lon.alias("lon"))
    other = F.struct((((F.col("c_custkey") * 31) % 17000) / 100.0 - 85).alias("lat"), (((F.col("c_custkey") * 17) % 36000) / 100.0 - 180).alias("lon"))
    df = df.withColumn("at", F.when(F.col("c_custkey") % 11 != 0, point)).withColumn("stops", F.when(F.col("c_custkey") % 2 == 0, F.array(point, other, point)).otherwise(F.array(other)))
    return Table.of(df, "c_custkey", "places", analyzers={"c_name": "raw", "c_mktsegment": "raw"})


PLACES = """(SELECT *, {'lat': lat, 'lon': lon} AS point, {'lat': lat2, 'lon': lon2} AS other, c_custkey % 11 <> 0 AS here,
  CASE WHEN c_custkey % 2 = 0 THEN [{'lat': lat, 'lon': lon}, {'lat': lat2, 'lon': lon2}, {'lat': lat, 'lon': lon}] ELSE [{'lat': lat2, 'lon': lon2}] END AS stops
 FROM (SELECT *, (c_custkey * 7919 % 17000) / 100.0::DOUBLE - 85 AS lat, (c_custkey * 104729 % 36000) / 100.0::DOUBLE - 180 AS lon,
   (c_custkey * 31 % 17000) / 100.0::DOUBLE - 85 AS lat2, (c_custkey * 17 % 36000) / 100.0::DOUBLE - 180 AS lon2 FROM customer)) c"""


def haversine_sql(p: str, lat: float, lon: float) -> str:
    a = f"(pow(sin(radians({p}.lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({p}.lat)) * pow(sin(radians({p}.lon - {lon}) / 2), 2))"
    return f"(2 * 6371008.8 * atan2(sqrt({a}), sqrt(1 - {a})))"


def cmp(column: str, op: str, value) -> dict:
    return {"kind": "compare", "column": column, "operator": op, "value": value}


def filtered(table: Table, f: dict, *columns: str) -> DataFrame:
    return reads.matching(table, f).select(*columns)


# predicates

for _op, _sql in {"equal": "=", "greater": ">", "greater_or_equal": ">=", "less": "<", "less_or_equal": "<="}.items():
    QUERIES[f"f01_compare_{_op}"] = lambda s, d, op=_op: filtered(lineitem(s, d), cmp("l_quantity", op, 25), "l_orderkey", "l_linenumber", "l_quantity")
    SQL[f"f01_compare_{_op}"] = f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sql} 25"


@query("f01_compare_not_equal_nulls", f"SELECT o_orderkey, priority FROM {ORDERS} WHERE priority IS DISTINCT FROM '1-URGENT'")
def _(s, d):
    return filtered(orders(s, d), cmp("priority", "not_equal", "1-URGENT"), "o_orderkey", "priority")


@query("f01_compare_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
def _(s, d):
    return filtered(orders(s, d), cmp("o_orderdate", "greater_or_equal", "1998-01-01T00:00:00"), "o_orderkey")


@query("f02_between", "SELECT event_id, value FROM events WHERE value BETWEEN 50 AND 200")
def _(s, d):
    return filtered(events(s, d), {"kind": "between", "column": "value", "lower": 50, "upper": 200}, "event_id", "value")


@query("f03_in", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def _(s, d):
    return filtered(events(s, d), {"kind": "in", "column": "event_type", "values": ["error", "signup", "error"]}, "event_id", "event_type")


@query("f03_in_large_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 45000 AND o_totalprice > 1000 ORDER BY o_orderkey")
def _(s, d):
    f = {"kind": "all", "filters": [{"kind": "in", "column": "o_orderkey", "values": list(range(0, 45000, 3))}, cmp("o_totalprice", "greater", 1000)]}
    return reads.read(orders(s, d), {"filter": f, "projection": [{"kind": "column", "column": c} for c in ("o_orderkey", "o_totalprice")], "order_by": [{"column": "o_orderkey"}], "limit": ALL})


@query("f04_is_null", f"SELECT o_orderkey FROM {ORDERS} WHERE priority IS NULL")
def _(s, d):
    return filtered(orders(s, d), {"kind": "is_null", "column": "priority", "negated": False}, "o_orderkey")


@query("f04_is_not_null", f"SELECT o_orderkey FROM {ORDERS} WHERE priority IS NOT NULL")
def _(s, d):
    return filtered(orders(s, d), {"kind": "is_null", "column": "priority", "negated": True}, "o_orderkey")


def has(t: str, term: str) -> str:
    return f"list_contains({t}, '{term}')"


@query("f05_search_or", f"SELECT doc_id FROM {DOCS} WHERE {has('toks', 'thing')} OR {has('toks', 'haben')}")
def _(s, d):
    return filtered(documents(s, d), {"kind": "search", "fields": ["text"], "query": "thing haben"}, "doc_id")


@query("f05_search_boolean", f"SELECT doc_id FROM {DOCS} WHERE ({has('toks', 'the')} AND {has('toks', 'that')}) AND NOT {has('toks', 'this')}")
def _(s, d):
    return filtered(documents(s, d), {"kind": "search", "fields": ["text"], "query": "(the AND that) -this"}, "doc_id")


def phrase_sql(words: list[str]) -> str:
    return f"len(list_filter(range(1, len(toks)), lambda i: {' AND '.join(f'toks[i + {k}] = {chr(39)}{w}{chr(39)}' for k, w in enumerate(words))})) > 0"


@query("f05_search_phrase", f"SELECT doc_id FROM {DOCS} WHERE {phrase_sql(['released', 'under', 'the', 'mit'])}")
def _(s, d):
    return filtered(documents(s, d), {"kind": "search", "fields": ["text"], "query": '"Released under the MIT"'}, "doc_id")


@query("f06_search_boosted_and", f"SELECT doc_id, 2.0 AS boost FROM {DOCS} WHERE {has('toks', 'thing')} AND {has('toks', 'the')}")
def _(s, d):
    """Each match with its score over that of the same words without a boost."""
    t = documents(s, d)
    boosted = {"kind": "search_boosted", "fields": {"text": 2.0}, "query": "thing the", "conjunction_by_default": True}
    plain = Lowering(t, scored=True).lower({**boosted, "fields": {"text": 1.0}})
    found = Lowering(t, scored=True).lower(boosted)
    return t.df.where(found.where).select("doc_id", F.round(found.score / plain.score, 9).alias("boost"))


@query("f07_fuzzy", f"SELECT doc_id FROM {DOCS} WHERE len(list_filter(toks, lambda t: levenshtein(t, 'license') <= 1)) > 0")
def _(s, d):
    return filtered(documents(s, d), {"kind": "fuzzy", "column": "text", "value": "license", "distance": 1}, "doc_id")


@query("f07_fuzzy_transposed", f"SELECT doc_id FROM {DOCS} WHERE len(list_filter(toks, lambda t: damerau_levenshtein(t, 'lciense') <= 1)) > 0")
def _(s, d):
    return filtered(documents(s, d), {"kind": "fuzzy", "column": "text", "value": "lciense", "distance": 1, "transposition_cost_one": True}, "doc_id")


@query("f08_prefix", f"SELECT doc_id FROM {DOCS} WHERE len(list_filter(toks, lambda t: starts_with(t, 'lice'))) > 0")
def _(s, d):
    return filtered(documents(s, d), {"kind": "prefix", "column": "text", "value": "lice"}, "doc_id")


@query("f09_phrase_prefix", f"SELECT doc_id FROM {DOCS} WHERE len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'under' AND toks[i + 1] = 'the' AND starts_with(toks[i + 2], 'm'))) > 0")
def _(s, d):
    return filtered(documents(s, d), {"kind": "phrase_prefix", "column": "text", "phrase": "under the m"}, "doc_id")


@query("f11_regex", f"SELECT doc_id FROM {DOCS} WHERE len(list_filter(toks, lambda t: regexp_full_match(t, 'licen.e'))) > 0")
def _(s, d):
    return filtered(documents(s, d), {"kind": "regex", "column": "text", "pattern": "licen.e"}, "doc_id")


@query("f12_regex_phrase", f"SELECT doc_id FROM {DOCS} WHERE len(list_filter(range(1, len(toks)), lambda i: regexp_full_match(toks[i], 'rel.*') AND regexp_full_match(toks[i + 1], 'und.r'))) > 0")
def _(s, d):
    return filtered(documents(s, d), {"kind": "regex_phrase", "column": "text", "patterns": ["rel.*", "und.r"]}, "doc_id")


@query(
    "f12_regex_phrase_slop",
    f"SELECT doc_id FROM {DOCS} WHERE len(list_filter(range(1, len(toks)), lambda i: regexp_full_match(toks[i], 'rel.*') AND (toks[i + 1] = 'the' OR toks[i + 2] = 'the' OR toks[i + 3] = 'the'))) > 0",
)
def _(s, d):
    return filtered(documents(s, d), {"kind": "regex_phrase", "column": "text", "patterns": ["rel.*", "the"], "slop": 2}, "doc_id")


@query("f13_json_search", "SELECT event_id FROM (SELECT *, json_object('note', event_type || ' by user ' || (user_id % 5)) AS note FROM events) WHERE list_contains(string_split(note->>'$.note', ' '), 'error') OR list_contains(string_split(note->>'$.note', ' '), '3')")
def _(s, d):
    df = _load(s, d, "events").withColumn("note", F.to_json(F.struct(F.concat("event_type", F.lit(" by user "), (F.col("user_id") % 5).cast("string")).alias("note"))))
    t = Table.of(df, "event_id", kinds={"note": "json", "props": "json"})
    return filtered(t, {"kind": "json_search", "column": "note", "path": "note", "query": "error 3"}, "event_id")


@query("f14_json_compare", "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) > 60")
def _(s, d):
    return filtered(events(s, d), {"kind": "json_compare", "column": "props", "path": "k", "data_type": "i64", "operator": "greater", "value": 60}, "event_id")


@query("f15_json_between", "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) BETWEEN 10 AND 20")
def _(s, d):
    return filtered(events(s, d), {"kind": "json_between", "column": "props", "path": "k", "data_type": "i64", "lower": 10, "upper": 20}, "event_id")


@query("f16_json_exists", "SELECT event_id FROM events WHERE props->>'$.k' IS NOT NULL")
def _(s, d):
    return filtered(events(s, d), {"kind": "json_exists", "column": "props", "path": "k"}, "event_id")


@query("f16_json_missing", "SELECT event_id FROM events WHERE props->>'$.zz' IS NULL")
def _(s, d):
    return filtered(events(s, d), {"kind": "json_exists", "column": "props", "path": "zz", "negated": True}, "event_id")


@query("f17_geo_distance", f"SELECT c_custkey FROM {PLACES} WHERE here AND {haversine_sql('point', 40.0, 10.0)} <= 2500000")
def _(s, d):
    return filtered(places(s, d), {"kind": "geo_distance", "column": "at", "center": {"lat": 40.0, "lon": 10.0}, "radius_meters": 2_500_000}, "c_custkey")


@query("f17_geo_distance_array", f"SELECT c_custkey FROM {PLACES} WHERE len(list_filter(stops, lambda x: {haversine_sql('x', -10.0, 179.0)} <= 3000000)) > 0")
def _(s, d):
    return filtered(places(s, d), {"kind": "geo_distance", "column": "stops", "center": {"lat": -10.0, "lon": 179.0}, "radius_meters": 3_000_000}, "c_custkey")


@query("f18_geo_box", f"SELECT c_custkey FROM {PLACES} WHERE here AND lat BETWEEN -20 AND 30 AND lon BETWEEN -50 AND 60")
def _(s, d):
    return filtered(places(s, d), {"kind": "geo_bounding_box", "column": "at", "bounds": {"top_left": {"lat": 30, "lon": -50}, "bottom_right": {"lat": -20, "lon": 60}}}, "c_custkey")


@query("f18_geo_box_antimeridian", f"SELECT c_custkey FROM {PLACES} WHERE here AND lat BETWEEN -20 AND 30 AND (lon >= 150 OR lon <= -160)")
def _(s, d):
    return filtered(places(s, d), {"kind": "geo_bounding_box", "column": "at", "bounds": {"top_left": {"lat": 30, "lon": 150}, "bottom_right": {"lat": -20, "lon": -160}}}, "c_custkey")


@query("f19_geo_distance_compare", f"SELECT c_custkey FROM {PLACES} WHERE list_max(list_transform(stops, lambda x: {haversine_sql('x', 0.0, 0.0)})) < 9000000")
def _(s, d):
    return filtered(places(s, d), {"kind": "geo_distance_compare", "column": "stops", "center": {"lat": 0.0, "lon": 0.0}, "mode": "max", "operator": "less", "distance_meters": 9_000_000}, "c_custkey")


@query("f20_all", "SELECT event_id FROM events WHERE event_type = 'error' AND value BETWEEN 50 AND 200")
def _(s, d):
    return filtered(events(s, d), {"kind": "all", "filters": [cmp("event_type", "equal", "error"), {"kind": "between", "column": "value", "lower": 50, "upper": 200}]}, "event_id")


@query("f21_any", f"SELECT o_orderkey FROM {ORDERS} WHERE coalesce(priority = '1-URGENT', false) OR o_totalprice < 5000")
def _(s, d):
    return filtered(orders(s, d), {"kind": "any", "filters": [cmp("priority", "equal", "1-URGENT"), cmp("o_totalprice", "less", 5000)]}, "o_orderkey")


@query("f22_not_with_nulls", f"SELECT o_orderkey FROM {ORDERS} WHERE NOT coalesce(priority < '3', false)")
def _(s, d):
    return filtered(orders(s, d), {"kind": "not", "filter": cmp("priority", "less", "3")}, "o_orderkey")


@query("f_array_any", f"SELECT p_partkey FROM {PARTS} WHERE len(list_filter(words, lambda w: w < 'b')) > 0")
def _(s, d):
    return filtered(parts(s, d), cmp("words", "less", "b"), "p_partkey")


@query("f_array_not_equal", f"SELECT p_partkey FROM {PARTS} WHERE NOT list_contains(words, split_part((SELECT min(p_name) FROM part), ' ', 1))")
def _(s, d):
    t = parts(s, d)
    first = t.df.agg(F.min("p_name")).first()[0].split(" ")[0]
    return filtered(t, cmp("words", "not_equal", first), "p_partkey")


# analyzers

for _name, _analyzer, _sql in (
    ("whitespace", "whitespace", r"list_filter(regexp_split_to_array(p_name, '\s+'), lambda t: t <> '')"),
    ("raw", "raw", "[p_name]"),
    ("ngram", {"ngram": {"min": 3, "max": 3}}, "list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))"),
    ("prefix_ngram", {"ngram": {"min": 2, "max": 3, "prefix_only": True}}, "[substr(p_name, 1, 2), substr(p_name, 1, 3)]"),
    ("stop_words", {"custom": {"stop_words": ["red", "small"]}}, r"list_filter(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), lambda t: t NOT IN ('red', 'small'))"),
    ("synonyms", {"custom": {"synonyms": {"red": ["crimson", "scarlet"]}}}, r"flatten(list_transform(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), lambda t: CASE WHEN t = 'red' THEN [t, 'crimson', 'scarlet'] ELSE [t] END))"),
):
    QUERIES[f"analyzer_{_name}"] = lambda s, d, a=_analyzer: _analyzed(s, d, a)
    SQL[f"analyzer_{_name}"] = f"SELECT p_partkey, array_to_string({_sql}, '|') AS tokens FROM part"


def _analyzed(s, d, analyzer) -> DataFrame:
    t = Table.of(_load(s, d, "part"), "p_partkey", analyzers={"p_name": analyzer})
    return t.df.select("p_partkey", F.array_join(t.tokens("p_name"), "|").alias("tokens"))


@query("analyzer_stem")
def _(s, d):
    t = Table.of(_load(s, d, "documents"), "doc_id", analyzers={"text": {"stem": "english"}})
    return t.df.select("doc_id", F.size(F.array_distinct(t.tokens("text"))).cast("long").alias("stems"))


# scores and reads

BM25 = """WITH d AS MATERIALIZED (SELECT doc_id, toks, len(toks) AS dl FROM {docs}), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
f AS (SELECT t, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(toks)) AS t FROM d) WHERE t IN ({terms}) GROUP BY t),
x AS (SELECT doc_id, dl, t, len(list_filter(toks, lambda y: y = t)) AS tf FROM d, f),
b AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 0.3 + 0.9 * dl / avgdl) ELSE 0 END) AS score FROM x JOIN f USING (t), s GROUP BY doc_id HAVING max(tf) > 0)
"""


def _scored(s, d, f: dict, **more) -> DataFrame:
    return reads.read(documents(s, d), {"projection": [{"kind": "column", "column": "doc_id"}, {"kind": "score", "alias": "score"}], "filter": f, "limit": ALL, **more})


@query("p02_score_bm25", BM25.format(docs=DOCS, terms="'thing', 'license'") + "SELECT doc_id, round(score, 6) AS score FROM b")
def _(s, d):
    return _scored(s, d, {"kind": "search", "fields": ["text"], "query": "thing license"}).withColumn("score", F.round("score", 6))


@query("p02_score_structural", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE lang = 'de'")
def _(s, d):
    return _scored(s, d, cmp("lang", "equal", "de"))


@query("o05_score_top_k", BM25.format(docs=DOCS, terms="'thing', 'license'") + "SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def _(s, d):
    return _scored(s, d, {"kind": "search", "fields": ["text"], "query": "thing license"}, limit=20).withColumn("score", F.round("score", 6))


@query("f25_min_score", BM25.format(docs=DOCS, terms="'thing', 'license'") + "SELECT doc_id FROM b WHERE score >= 2.5")
def _(s, d):
    return _scored(s, d, {"kind": "search", "fields": ["text"], "query": "thing license"}, min_score=2.5).select("doc_id")


@query("o06_score_and_field", BM25.format(docs=DOCS, terms="'thing', 'license'") + "SELECT doc_id, lang, round(score, 6) AS score FROM b JOIN documents USING (doc_id) ORDER BY lang, b.score DESC, doc_id LIMIT 30")
def _(s, d):
    f = {"kind": "search", "fields": ["text"], "query": "thing license"}
    return reads.read(documents(s, d), {"projection": [{"kind": "column", "column": "doc_id"}, {"kind": "column", "column": "lang"}, {"kind": "score", "alias": "score"}], "filter": f, "order_by": [{"column": "lang"}, {"column": "_score", "descending": True}], "limit": 30}).withColumn("score", F.round("score", 6))


@query(
    "f10_disjunction_max",
    "WITH " + BM25.format(docs=DOCS, terms="'src1', 'license'").removeprefix("WITH ").rstrip() + """,
n AS (SELECT count(*) AS n, sum((source = 'src1')::INT) AS df FROM documents),
z AS (SELECT doc_id, coalesce(b.score, 0) AS a, CASE WHEN source = 'src1' THEN 2 * ln(1 + (n.n - n.df + 0.5) / (n.df + 0.5)) * 2.2 / (1 + 0.3 + 0.9) ELSE 0 END AS c FROM documents LEFT JOIN b USING (doc_id), n WHERE b.score IS NOT NULL OR source = 'src1')
SELECT doc_id, round(greatest(a, c) + 0.3 * least(a, c), 6) AS score FROM z""",
)
def _(s, d):
    return _scored(s, d, {"kind": "disjunction_max", "fields": {"text": 1.0, "source": 2.0}, "query": "src1 license", "tie_breaker": 0.3}).withColumn("score", F.round("score", 6))


@query("p00_all_columns", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    return reads.read(Table.of(_load(s, d, "region"), "r_regionkey"), {})


@query("p01_column_alias", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def _(s, d):
    return reads.read(orders(s, d), {"projection": [{"kind": "column", "column": "O_ORDERKEY", "alias": "id"}, {"kind": "column", "column": "o_totalprice", "alias": "price"}], "order_by": [{"column": "price", "descending": True}], "limit": 15})


@query("p03_highlight")
def _(s, d):
    return reads.read(documents(s, d), {"projection": [{"kind": "column", "column": "doc_id"}, {"kind": "highlight", "column": "text", "alias": "mark"}], "filter": {"kind": "search", "fields": ["text"], "query": "license"}, "limit": ALL})


for _mode, _fn in {"min": "list_min", "max": "list_max", "average": "list_avg"}.items():
    QUERIES[f"p04_geo_distance_{_mode}"] = lambda s, d, m=_mode: reads.read(
        places(s, d), {"projection": [{"kind": "column", "column": "c_custkey"}, {"kind": "geo_distance", "column": "stops", "from": {"lat": 12.5, "lon": 7.25}, "mode": m}], "limit": ALL}
    ).select("c_custkey", F.round("stops_distance_meters", 3).alias("meters"))
    SQL[f"p04_geo_distance_{_mode}"] = f"SELECT c_custkey, round({_fn}(list_transform(stops, lambda x: {haversine_sql('x', 12.5, 7.25)})), 3) AS meters FROM {PLACES}"


def page(table: Table, columns: list[str], order: list[dict], **more) -> DataFrame:
    return reads.read(table, {"projection": [{"kind": "column", "column": c} for c in columns], "order_by": order, **more})


@query("o01_nulls_last_ascending", f"SELECT o_orderkey, priority FROM {ORDERS} WHERE o_totalprice < 3000 OR priority IS NULL ORDER BY priority NULLS LAST, o_orderkey LIMIT 200")
def _(s, d):
    f = {"kind": "any", "filters": [cmp("o_totalprice", "less", 3000), {"kind": "is_null", "column": "priority", "negated": False}]}
    return page(orders(s, d), ["o_orderkey", "priority"], [{"column": "priority"}], filter=f, limit=200)


@query("o01_nulls_first_descending", f"SELECT o_orderkey, priority FROM {ORDERS} ORDER BY priority DESC NULLS FIRST, o_orderkey LIMIT 3000")
def _(s, d):
    return page(orders(s, d), ["o_orderkey", "priority"], [{"column": "priority", "descending": True}], limit=3000)


@query("o04_three_keys", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 50")
def _(s, d):
    return page(orders(s, d), ["o_orderkey"], [{"column": "o_orderstatus"}, {"column": "o_orderpriority", "descending": True}, {"column": "o_totalprice"}], limit=50)


@query("o07_json_sort", "SELECT event_id FROM events ORDER BY CAST(props->>'$.k' AS BIGINT) DESC, event_id LIMIT 40")
def _(s, d):
    return page(events(s, d), ["event_id"], [{"column": "props", "json_path": "k", "json_type": "i64", "descending": True}], limit=40)


@query("o08_geo_sort", f"SELECT c_custkey FROM {PLACES} WHERE here ORDER BY {haversine_sql('point', 50.0, 5.0)}, c_custkey LIMIT 25")
def _(s, d):
    return page(places(s, d), ["c_custkey"], [{"column": "at", "geo_distance_from": {"lat": 50.0, "lon": 5.0}}], limit=25, filter={"kind": "is_null", "column": "at", "negated": True})


@query("o11_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40")
def _(s, d):
    return page(orders(s, d), ["o_orderkey", "o_totalprice"], [{"column": "o_totalprice"}], limit=20, offset=40)


@query("o12_search_after", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-03-01 00:00:00', 500) ORDER BY o_orderdate, o_orderkey LIMIT 60")
def _(s, d):
    return page(orders(s, d), ["o_orderkey", "o_orderdate"], [{"column": "o_orderdate"}], limit=60, search_after=["1997-03-01T00:00:00", 500]).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("x06_list_rows", "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 25 OFFSET 5")
def _(s, d):
    return reads.list_rows(Table.of(_load(s, d, "supplier"), "s_suppkey"), limit=25, offset=5)


@query("baseline_filter_sort_page", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value FROM events WHERE event_type = 'error' AND value BETWEEN 50 AND 200 ORDER BY ts DESC, event_id LIMIT 20")
def _(s, d):
    f = {"kind": "all", "filters": [cmp("event_type", "equal", "error"), {"kind": "between", "column": "value", "lower": 50, "upper": 200}]}
    return page(events(s, d), ["event_id", "ts", "value"], [{"column": "ts", "descending": True}], filter=f, limit=20).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "value")


@query("baseline_key_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def _(s, d):
    return page(orders(s, d), ["o_orderkey", "o_totalprice"], [], filter=cmp("o_orderkey", "equal", 77))


# tabular aggregation


def agg(function: str, column: str | None = None, alias: str | None = None) -> dict:
    return {"kind": "aggregate", "function": function, "column": column, "alias": alias or function}


def grouped(table: Table, keys: list[str], aggregates: list[dict], **more) -> DataFrame:
    return reads.read(table, {"projection": [{"kind": "column", "column": k} for k in keys] + aggregates, "group_by": keys, **more})


@query("a01_count", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def _(s, d):
    return grouped(events(s, d), [], [agg("count", None, "n")], filter=cmp("event_type", "equal", "click"))


@query("a01_count_nullable", f"SELECT count(*) AS n, count(priority) AS n_priority FROM {ORDERS}")
def _(s, d):
    return grouped(orders(s, d), [], [agg("count", "o_orderkey", "n"), agg("count", "priority", "n_priority")])


@query("a02_sum_average_min_max", "SELECT l_returnflag, round(sum(l_quantity), 4) AS s, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    df = grouped(lineitem(s, d), ["l_returnflag"], [agg("sum", "l_quantity", "s"), agg("average", "l_extendedprice", "a"), agg("min", "l_discount", "lo"), agg("max", "l_tax", "hi"), agg("count", None, "n")])
    return df.withColumns({"s": F.round("s", 4), "a": F.round("a", 4)})


@query("a07_group_null", f"SELECT priority, count(*) AS n FROM {ORDERS} GROUP BY priority")
def _(s, d):
    return grouped(orders(s, d), ["priority"], [agg("count", None, "n")])


@query("a07_group_multi", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL")
def _(s, d):
    return grouped(lineitem(s, d), ["l_returnflag", "l_linestatus", "l_linenumber"], [agg("count", None, "n"), agg("max", "l_quantity", "q")], limit=ALL)


@query("a08_group_top_n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")
def _(s, d):
    return grouped(orders(s, d), ["o_custkey"], [agg("count", None, "n")], limit=20)


@query("a09_group_order_offset", "SELECT p_brand, max(p_retailprice) AS top FROM part GROUP BY p_brand ORDER BY top DESC, p_brand LIMIT 8 OFFSET 3")
def _(s, d):
    return grouped(parts(s, d), ["p_brand"], [agg("max", "p_retailprice", "top")], order_by=[{"column": "top", "descending": True}], limit=8, offset=3)


@query("a07_search_grouped", f"SELECT lang, count(*) AS n FROM {DOCS} WHERE {has('toks', 'license')} GROUP BY lang")
def _(s, d):
    return grouped(documents(s, d), ["lang"], [agg("count", None, "n")], filter={"kind": "search", "fields": ["text"], "query": "license"})


# buckets


def bucket(table: Table, node: dict, path: str = "b", filter_: dict | None = None) -> DataFrame:
    return buckets.aggregate(table, {"b": node}, filter_)[path]


def metric(function: str, column: str | None = None, **more) -> dict:
    return {"kind": "metric", "function": function, "column": column, **more}


@query("b01_terms", "SELECT p_brand AS b_key, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    return bucket(parts(s, d), {"kind": "terms", "column": "p_brand"})


@query("b01_terms_missing", f"SELECT coalesce(priority, 'none') AS b_key, count(*) AS doc_count FROM {ORDERS} GROUP BY 1")
def _(s, d):
    return bucket(orders(s, d), {"kind": "terms", "column": "priority", "missing": "none", "size": 100})


@query("b01_terms_metric_order", "SELECT o_custkey AS b_key, count(*) AS doc_count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 12")
def _(s, d):
    return bucket(orders(s, d), {"kind": "terms", "column": "o_custkey", "size": 12, "order": {"target": "total", "descending": True}, "aggregations": {"total": metric("sum", "o_totalprice")}}).withColumn("total", F.round("total", 2))


@query("b01_terms_array", f"SELECT w AS b_key, count(*) AS doc_count FROM (SELECT p_partkey, unnest(list_distinct(words)) AS w FROM {PARTS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    return bucket(parts(s, d), {"kind": "terms", "column": "words"})


@query("b01_terms_min_count_key_order", "SELECT o_custkey AS b_key, count(*) AS doc_count FROM orders GROUP BY 1 HAVING count(*) >= 12 ORDER BY 1 LIMIT 50")
def _(s, d):
    return bucket(orders(s, d), {"kind": "terms", "column": "o_custkey", "size": 50, "min_doc_count": 12, "order": {"target": "_key", "descending": False}})


@query("b02_json_terms", "SELECT CAST(props->>'$.k' AS BIGINT) AS b_key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    return bucket(events(s, d), {"kind": "json_terms", "target": {"column": "props", "path": "k", "data_type": "i64"}})


@query("b03_histogram", "SELECT floor(l_extendedprice / 5000) * 5000 AS b_key, count(*) AS doc_count, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY 1")
def _(s, d):
    return bucket(lineitem(s, d), {"kind": "histogram", "column": "l_extendedprice", "interval": 5000, "min_doc_count": 1, "aggregations": {"q": metric("average", "l_quantity")}}).withColumn("q", F.round("q", 6))


@query(
    "b03_histogram_gap_fill",
    "SELECT k / 8.0 AS b_key, count(v) AS doc_count FROM range(-160, 4001) r(k) LEFT JOIN (SELECT value AS v FROM events WHERE value BETWEEN 0 AND 480) ON floor(v / 0.125) = k GROUP BY 1",
)
def _(s, d):
    return bucket(events(s, d), {"kind": "histogram", "column": "value", "interval": 0.125, "hard_bounds": {"min": 0, "max": 480}, "extended_bounds": {"min": -20, "max": 500}})


@query("b04_json_histogram", "SELECT floor(CAST(props->>'$.k' AS BIGINT) / 15.0) * 15.0 AS b_key, count(*) AS doc_count FROM events GROUP BY 1")
def _(s, d):
    return bucket(events(s, d), {"kind": "json_histogram", "target": {"column": "props", "path": "k", "data_type": "i64"}, "interval": 15, "min_doc_count": 1})


@query("b05_date_histogram", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 01:00:00'), '%Y-%m-%d %H:%M:%S') AS b_key, count(*) AS doc_count FROM events GROUP BY 1")
def _(s, d):
    df = bucket(events(s, d), {"kind": "date_histogram", "column": "ts", "fixed_interval": "6h", "offset": "1h", "min_doc_count": 1})
    return df.withColumn("b_key", F.date_format("b_key", "yyyy-MM-dd HH:mm:ss"))


@query("b06_range", "SELECT b_key, count(value) AS doc_count FROM (VALUES ('low', -1e9, 50.0), ('mid', 40.0, 200.0), ('high', 200.0, 1e9), ('none', 1e6, 2e6)) r(b_key, lo, hi) LEFT JOIN events ON value >= lo AND value < hi GROUP BY 1")
def _(s, d):
    return bucket(events(s, d), {"kind": "range", "column": "value", "keyed": True, "ranges": [{"key": "low", "to": 50}, {"key": "mid", "from": 40, "to": 200}, {"key": "high", "from": 200}, {"key": "none", "from": 1e6, "to": 2e6}]})


@query("b07_json_range", "SELECT CASE WHEN k < 30 THEN '*-30' ELSE '30-*' END AS b_key, count(*) AS doc_count FROM (SELECT CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY 1")
def _(s, d):
    return bucket(events(s, d), {"kind": "json_range", "target": {"column": "props", "path": "k", "data_type": "i64"}, "ranges": [{"to": 30}, {"from": 30}]})


@query("b08_filter_bucket", "SELECT count(*) AS doc_count, round(avg(value), 6) AS v FROM events WHERE event_type = 'purchase'")
def _(s, d):
    return bucket(events(s, d), {"kind": "filter", "filter": cmp("event_type", "equal", "purchase"), "aggregations": {"v": metric("average", "value")}}).withColumn("v", F.round("v", 6))


_COMPOSITE = [{"kind": "terms", "name": "prio", "column": "priority", "missing_bucket": True}, {"kind": "terms", "name": "status", "column": "o_orderstatus", "descending": True}]


@query("b09_composite", f"SELECT priority AS prio_key, o_orderstatus AS status_key, count(*) AS doc_count FROM {ORDERS} GROUP BY 1, 2 ORDER BY 1 NULLS FIRST, 2 DESC LIMIT 7")
def _(s, d):
    return bucket(orders(s, d), {"kind": "composite", "sources": _COMPOSITE, "size": 7})


@query("b09_composite_after", f"SELECT priority AS prio_key, o_orderstatus AS status_key, count(*) AS doc_count FROM {ORDERS} WHERE priority > '2-HIGH' OR (priority = '2-HIGH' AND o_orderstatus < 'O') GROUP BY 1, 2 ORDER BY 1, 2 DESC LIMIT 7")
def _(s, d):
    return bucket(orders(s, d), {"kind": "composite", "sources": _COMPOSITE, "size": 7, "after": {"prio": "2-HIGH", "status": "O"}})


@query("b09b_composite_histogram", "SELECT floor(l_quantity / 10) * 10 AS q_key, l_returnflag AS flag_key, count(*) AS doc_count FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return bucket(lineitem(s, d), {"kind": "composite", "size": 1000, "sources": [{"kind": "histogram", "name": "q", "column": "l_quantity", "interval": 10}, {"kind": "terms", "name": "flag", "column": "l_returnflag"}]})


for _unit in ("year", "month", "week"):
    QUERIES[f"b09c_calendar_{_unit}"] = lambda s, d, u=_unit: bucket(orders(s, d), {"kind": "composite", "size": 1000, "sources": [{"kind": "date_histogram", "name": "at", "column": "o_orderdate", "calendar_interval": u}]}).select(F.date_format("at_key", "yyyy-MM-dd").alias("at_key"), "doc_count")
    SQL[f"b09c_calendar_{_unit}"] = f"SELECT strftime(date_trunc('{_unit}', o_orderdate), '%Y-%m-%d') AS at_key, count(*) AS doc_count FROM orders GROUP BY 1"


@query("b09d_composite_json", "SELECT CAST(props->>'$.k' AS BIGINT) AS k_key, event_type AS type_key, count(*) AS doc_count FROM events GROUP BY 1, 2")
def _(s, d):
    return bucket(events(s, d), {"kind": "composite", "size": 10_000, "sources": [{"kind": "json_terms", "name": "k", "target": {"column": "props", "path": "k", "data_type": "i64"}}, {"kind": "terms", "name": "type", "column": "event_type"}]})


@query(
    "b09e_missing_bucket_children",
    f"""WITH c AS (SELECT priority, o_orderstatus, count(*) AS n, row_number() OVER (PARTITION BY priority ORDER BY count(*) DESC, o_orderstatus) AS r FROM {ORDERS} GROUP BY 1, 2)
    SELECT priority AS pr_key, o_orderstatus AS kids_key, n AS doc_count FROM c WHERE r <= 2""",
)
def _(s, d):
    sources = [{"kind": "terms", "name": "pr", "column": "priority", "missing_bucket": True}]
    return bucket(orders(s, d), {"kind": "composite", "size": 100, "sources": sources, "aggregations": {"kids": {"kind": "terms", "column": "o_orderstatus", "size": 2}}}, "b.kids")


@query(
    "b09e_missing_bucket_histogram",
    f"""WITH t AS (SELECT priority, (floor(o_totalprice / 50000) * 50000)::DOUBLE AS h, count(*) AS n FROM {ORDERS} GROUP BY 1, 2),
    e AS (SELECT priority, unnest(range((min(h) / 50000)::BIGINT, (max(h) / 50000)::BIGINT + 1)) * 50000.0 AS h FROM t GROUP BY 1)
    SELECT e.priority AS pr_key, e.h::DOUBLE AS kids_key, coalesce(n, 0)::BIGINT AS doc_count FROM e LEFT JOIN t ON e.priority IS NOT DISTINCT FROM t.priority AND e.h = t.h""",
)
def _(s, d):
    sources = [{"kind": "terms", "name": "pr", "column": "priority", "missing_bucket": True}]
    return bucket(orders(s, d), {"kind": "composite", "size": 100, "sources": sources, "aggregations": {"kids": {"kind": "histogram", "column": "o_totalprice", "interval": 50000}}}, "b.kids")


@query("b10_metric_json_missing", "SELECT round(avg(coalesce(CAST(props->>'$.k' AS BIGINT), 0)), 6) AS value FROM events")
def _(s, d):
    return bucket(events(s, d), metric("average", None, json_path={"column": "props", "path": "k", "data_type": "i64"}, missing=0)).select(F.round("value", 6).alias("value"))


@query("b10f_cardinality")
def _(s, d):
    return bucket(orders(s, d), metric("cardinality", "o_custkey"))


@query("b10f_cardinality_exact", "SELECT count(DISTINCT o_custkey) AS value FROM orders")
def _(s, d):
    return bucket(orders(s, d), metric("cardinality", "o_custkey", exact=True))


@query("b10g_percentiles")
def _(s, d):
    return bucket(lineitem(s, d), metric("percentiles", "l_extendedprice"))


@query("b10g_percentiles_exact", "SELECT round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem")
def _(s, d):
    found = bucket(lineitem(s, d), metric("percentiles", "l_extendedprice", exact=True, percents=[50, 95]))
    return found.select(F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("b10h_stats", 'SELECT count(l_tax) AS "count", round(sum(l_tax), 4) AS "sum", round(avg(l_tax), 6) AS average, min(l_tax) AS "min", max(l_tax) AS "max" FROM lineitem')
def _(s, d):
    return bucket(lineitem(s, d), metric("stats", "l_tax")).withColumns({"sum": F.round("sum", 4), "average": F.round("average", 6)})


@query("b10i_extended_stats", "SELECT round(sum(l_quantity * l_quantity), 2) AS sum_of_squares, round(var_pop(l_quantity), 4) AS variance, round(var_samp(l_quantity), 4) AS variance_sampling, round(stddev_pop(l_quantity), 4) AS std_deviation, round(stddev_samp(l_quantity), 4) AS std_deviation_sampling FROM lineitem")
def _(s, d):
    df = bucket(lineitem(s, d), metric("extended_stats", "l_quantity"))
    return df.select(F.round("sum_of_squares", 2).alias("sum_of_squares"), *[F.round(c, 4).alias(c) for c in ("variance", "variance_sampling", "std_deviation", "std_deviation_sampling")])


@query("b11_top_hits", "SELECT b_key, rank::INT AS rank, p_partkey, p_retailprice FROM (SELECT p_brand AS b_key, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, p_partkey, p_retailprice FROM part) WHERE rank <= 3 AND b_key IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)")
def _(s, d):
    return bucket(parts(s, d), {"kind": "terms", "column": "p_brand", "size": 5, "aggregations": {"hits": {"kind": "top_hits", "size": 3, "sort": [{"column": "p_retailprice", "descending": True}], "columns": ["p_partkey", "p_retailprice"]}}}, "b.hits")


_TILE = "CASE WHEN {p}.lon = 180 THEN -180 ELSE {p}.lon END"
_LAT = "radians(least(greatest({p}.lat, -85.0511287798066), 85.0511287798066))"


def tile_sql(p: str, zoom: int) -> tuple[str, str]:
    n = 2**zoom
    lat = _LAT.format(p=p)
    return (f"least(greatest(floor(({_TILE.format(p=p)} + 180) / 360 * {n}), 0), {n - 1})::BIGINT", f"least(greatest(floor((1 - asinh(tan({lat})) / pi()) / 2 * {n}), 0), {n - 1})::BIGINT")


for _mode, _distinct in (("documents", "DISTINCT "), ("points", "")):
    QUERIES[f"b12_geo_tiles_{_mode}"] = lambda s, d, m=_mode: bucket(places(s, d), {"kind": "geo_tile_grid", "column": "stops", "zoom": 6, "count_mode": m, "max_buckets": 100_000})
    _x, _y = tile_sql("p", 6)
    SQL[f"b12_geo_tiles_{_mode}"] = f"SELECT 6 AS z, x, y, count(*) AS doc_count FROM (SELECT {_distinct}c_custkey, {_x} AS x, {_y} AS y FROM (SELECT c_custkey, unnest(stops) AS p FROM {PLACES})) GROUP BY x, y"


@query("b13_nested", "SELECT a.b_key, inner_key, doc_count, round(avg_price, 4) AS p FROM (SELECT o_orderstatus AS b_key, o_orderpriority AS inner_key, count(*) AS doc_count, avg(o_totalprice) AS avg_price, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) a WHERE r <= 2")
def _(s, d):
    node = {"kind": "terms", "column": "o_orderstatus", "aggregations": {"inner": {"kind": "terms", "column": "o_orderpriority", "size": 2, "aggregations": {"p": metric("average", "o_totalprice")}}}}
    return bucket(orders(s, d), node, "b.inner").withColumn("p", F.round("p", 4))


@query("b15_partial_merge", "SELECT o_orderstatus AS key, count(*) AS doc_count, round(sum(o_totalprice), 2) AS sum, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS average FROM orders GROUP BY 1")
def _(s, d):
    t = orders(s, d)
    halves = [buckets.partial_terms(t.with_df(t.df.where(F.col("o_orderkey") % 2 == k)), "o_orderstatus", "o_totalprice") for k in (0, 1)]
    return buckets.merge_terms(halves).drop("cardinality").withColumns({"sum": F.round("sum", 2), "average": F.round("average", 4)})


_FACET = "'/' || split_part(path, '/', 2)"


@query("b16_facets", f"SELECT {_FACET} AS path, count(*) AS doc_count FROM {PARTS} WHERE p_size > 20 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    return facets.facets(parts(s, d), "path", "/", 10, cmp("p_size", "greater", 20))


@query("b16_facets_exclude_own", f"SELECT {_FACET} AS path, count(*) AS doc_count FROM {PARTS} WHERE p_size > 20 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    f = {"kind": "all", "filters": [cmp("path", "equal", "/none"), cmp("p_size", "greater", 20)]}
    return facets.facets(parts(s, d), "path", "/", 10, f, exclude_own_filter=True)


# other analysis

_MLT = """WITH d AS MATERIALIZED (SELECT doc_id, toks, len(toks) AS dl FROM {docs}), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
seed AS (SELECT t, count(*) AS tf FROM (SELECT unnest(toks) AS t FROM d WHERE doc_id = 2) GROUP BY t HAVING count(*) >= 2),
f AS (SELECT t, tf, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM seed JOIN (SELECT t, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(toks)) AS t FROM d) GROUP BY t) USING (t), s WHERE df >= 2),
q AS (SELECT t, idf FROM f ORDER BY tf * idf DESC, t LIMIT 25),
x AS (SELECT doc_id, dl, t, idf, len(list_filter(toks, lambda y: y = t)) AS tf FROM d, q WHERE doc_id <> 2)
SELECT doc_id, round(sum(CASE WHEN tf > 0 THEN idf * 2.2 * tf / (tf + 0.3 + 0.9 * dl / avgdl) ELSE 0 END), 6) AS score FROM x, s GROUP BY doc_id HAVING max(tf) > 0
ORDER BY sum(CASE WHEN tf > 0 THEN idf * 2.2 * tf / (tf + 0.3 + 0.9 * dl / avgdl) ELSE 0 END) DESC, doc_id LIMIT 20"""


@query("x01_more_like_this", _MLT.format(docs=DOCS))
def _(s, d):
    return similar.more_like_this(documents(s, d), 2, ["text"]).select("doc_id", F.round("_score", 6).alias("score"))


@query("x03_explain_score", BM25.format(docs=DOCS, terms="'the', 'license'") + "SELECT doc_id, 'text' AS field, t AS term, tf::BIGINT AS tf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM x JOIN f USING (t), s WHERE doc_id = (SELECT min(doc_id) FROM b)")
def _(s, d):
    t = documents(s, d)
    f = {"kind": "search", "fields": ["text"], "query": "the license"}
    first = reads.read(t, {"projection": [{"kind": "column", "column": "doc_id"}], "filter": f, "order_by": [{"column": "doc_id"}], "limit": 1}).first()[0]
    return reads.explain_score(t, f, first).select("doc_id", "field", "term", F.col("tf").cast("long").alias("tf"), F.round("idf", 6).alias("idf"))


# mutations: the state of a table after them


def _shared(s: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; without that only a local session has one."""
    import tempfile
    import uuid

    base = s.conf.get("spark.checkpoint.dir", None)
    if not base and not s.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return f"{base or tempfile.mkdtemp(prefix='spark-querymill-')}/catalog/{uuid.uuid4().hex}"


def _catalog(s: SparkSession, d: str) -> catalog.Catalog:
    """A new catalog with the orders of the driver's table."""
    c = catalog.Catalog(s, _shared(s))
    t = orders(s, d)
    c.create(catalog.Definition("orders", tuple(t.columns.values()), "o_orderkey", ("sales",)))
    c.upsert("orders", t.df)
    return c


_STATE = ["o_orderkey", "o_custkey", "o_totalprice", "priority"]


def _row(key: int, **more) -> dict:
    return {"o_orderkey": key, "o_custkey": 1, "o_orderstatus": "O", "o_totalprice": 5.5, "o_orderdate": "2000-01-01T00:00:00", "o_orderpriority": "5-LOW", "priority": None} | more


@query("m01_insert", f"SELECT o_orderkey, o_custkey, o_totalprice, priority FROM {ORDERS} UNION ALL SELECT -1, 1, 5.5, NULL")
def _(s, d):
    c = _catalog(s, d)
    c.insert("sales", [_row(-1)])
    return c.table("orders").df.select(*_STATE)


@query("m02_update", f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1.5 ELSE o_totalprice END AS o_totalprice, priority FROM {ORDERS}")
def _(s, d):
    c = _catalog(s, d)
    c.update("orders", {"o_totalprice": 1.5}, cmp("o_orderstatus", "equal", "F"))
    return c.table("orders").df.select(*_STATE)


@query("m03_delete", f"SELECT o_orderkey, o_custkey, o_totalprice, priority FROM {ORDERS} WHERE priority IS NOT NULL")
def _(s, d):
    c = _catalog(s, d)
    c.delete("orders", {"kind": "is_null", "column": "priority", "negated": False})
    return c.table("orders").df.select(*_STATE)


@query("m04_upsert", f"SELECT o_orderkey, o_custkey, o_totalprice, priority FROM {ORDERS} WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT min(o_orderkey), 9, 8.0, 'x' FROM orders UNION ALL SELECT -5, 1, 5.5, NULL")
def _(s, d):
    c = _catalog(s, d)
    first = c.table("orders").df.agg(F.min("o_orderkey")).first()[0]
    c.upsert("orders", [_row(first), _row(-5), _row(first, o_custkey=9, o_totalprice=8.0, priority="x")])
    return c.table("orders").df.select(*_STATE)


@query("m05_batch", f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE o_totalprice END AS o_totalprice, priority FROM {ORDERS} WHERE o_orderstatus <> 'P' UNION ALL SELECT -1, 1, 5.5, NULL")
def _(s, d):
    c = _catalog(s, d)
    c.batch([{"kind": "insert", "table": "orders", "row": _row(-1)}, {"kind": "delete", "table": "orders", "filter": cmp("o_orderstatus", "equal", "P")}, {"kind": "update", "table": "orders", "values": {"o_totalprice": 0.5}, "filter": cmp("o_orderstatus", "equal", "F")}])
    return c.table("orders").df.select(*_STATE)


@query("m06_deferred_flush", f"SELECT o_orderkey, o_custkey, o_totalprice, priority FROM {ORDERS} UNION ALL SELECT -2, 3, 5.5, NULL")
def _(s, d):
    c = _catalog(s, d)
    c.upsert("orders", [_row(-2)], deferred=True)
    c.upsert("orders", [_row(-2, o_custkey=3)], deferred=True)
    c.flush("orders")
    return c.table("orders").df.select(*_STATE)


@query("m09_schema_change", f"SELECT o_orderkey, o_custkey::DOUBLE AS customer, 7::BIGINT AS extra FROM {ORDERS}")
def _(s, d):
    from querymill.table import ColumnDef

    c = _catalog(s, d)
    c.change("orders", {"kind": "add_column", "column": ColumnDef("extra", "integer", False), "default": 7})
    c.change("orders", {"kind": "alter_column", "column": "o_custkey", "definition": ColumnDef("o_custkey", "real")})
    c.change("orders", {"kind": "rename_column", "from": "o_custkey", "to": "customer"})
    c.change("orders", {"kind": "drop_column", "column": "o_totalprice"})
    return c.table("orders").df.select("o_orderkey", "customer", "extra")


@query("m10_optimize", f"SELECT o_orderkey, o_custkey, o_totalprice, priority FROM {ORDERS}")
def _(s, d):
    c = _catalog(s, d)
    c.optimize("orders", 3)
    return c.table("orders").df.select(*_STATE)


@query("s04_import_upsert", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE o_custkey END AS o_custkey, o_totalprice, priority FROM {ORDERS}")
def _(s, d):
    from querymill.sources import ndjson

    c = _catalog(s, d)
    path = c.store.at("orders", "incoming")
    lines = c.table("orders").df.where("o_orderkey % 2 = 0").withColumn("o_custkey", F.lit(1)).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    lines.select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(path)
    ndjson.import_file(c, "orders", path)
    return c.table("orders").df.select(*_STATE)


@query("s04_import_skip", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE o_custkey END AS o_custkey, o_totalprice, priority, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0) AS rejected FROM {ORDERS}")
def _(s, d):
    """Lines with a value of another type are counted and left out; the others are upserted."""
    from querymill.sources import ndjson

    c = _catalog(s, d)
    path = c.store.at("orders", "incoming")
    lines = c.table("orders").df.where("o_orderkey % 2 = 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 4 == 0, "bad").otherwise("1")).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    lines.select(F.replace(F.to_json(F.struct("*")), F.lit('"o_custkey":"1"'), F.lit('"o_custkey":1')).alias("value")).write.text(path)
    report = ndjson.import_report(c, "orders", path, on_error="skip")
    return c.table("orders").df.select(*_STATE, F.lit(report["rejected"]).cast("long").alias("rejected"))


@query(
    "s07_flatten_nested",
    "SELECT o_orderkey, o_orderstatus, parts::VARCHAR AS parts, quantities::VARCHAR AS quantities FROM (SELECT o_orderkey, o_orderstatus, list_prepend(o_custkey, coalesce(parts, [])) AS parts, coalesce(quantities, []) AS quantities "
    "FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(l_partkey)) AS parts, list_sort(list(l_quantity) FILTER (WHERE l_returnflag <> 'R')) AS quantities FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)",
)
def _(s, d):
    """Orders with their lines nested are written as NDJSON and read flat: the customer and the lines' parts in one array."""
    from querymill.sources import ndjson

    kept = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    lines = _load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), kept.alias("quantity"))).alias("lines"))
    nested = _load(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "o_custkey", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"))
    path = f"{_shared(s)}/nested"
    nested.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    flat = ndjson.read_flattened(s, path, {"o_orderkey": ("bigint", "o_orderkey"), "o_orderstatus": ("string", "o_orderstatus"), "parts": ("bigint", ["o_custkey", "lines[].part"]), "quantities": ("double", ["lines[].quantity"])})
    text = lambda c: F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    parts = F.col("parts")
    first, rest = F.slice(parts, 1, 1), F.sort_array(F.slice(parts, F.lit(2), F.size(parts)))
    return flat.select("o_orderkey", "o_orderstatus", text(F.concat(first, rest)).alias("parts"), text(F.sort_array("quantities")).alias("quantities"))


@query("s08_backup_restore", f"SELECT o_orderkey, o_custkey, o_totalprice, priority FROM {ORDERS}")
def _(s, d):
    from querymill.sources import backup

    c = _catalog(s, d)
    backup.backup(c, c.store.root + ".backup")
    c.delete("orders", cmp("o_orderkey", "greater", 0))
    backup.restore(c, c.store.root + ".backup", force=True)
    return c.table("orders").df.select(*_STATE)


@query("t01_streaming_upsert", f"SELECT o_orderkey, o_custkey, o_totalprice, priority FROM {ORDERS}")
def _(s, d):
    from querymill.streaming import upserts

    c = _catalog(s, d)
    path = c.store.at("orders", "incoming")
    c.table("orders").df.repartition(3).write.parquet(path)
    c.delete("orders", cmp("o_orderkey", "greater", 0))
    upserts.upsert_stream(c, "orders", upserts.parquet_stream(c, "orders", path), c.store.root + ".progress").awaitTermination()
    return c.table("orders").df.select(*_STATE)
