"""Mixing, chat formatting and host rules: odd rows, and what the SQL oracles cannot say."""

import json
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from querymill.llm import chat, common, host_rules, langid, mixing, queries, resample

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(map(repr, d[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


# mixing


def test_targets_stop_at_three_times_their_size(spark):
    df = spark.createDataFrame([("a", 10, 5), ("b", 1000, 2), ("c", 0, 1), (None, 90, 5)], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == {"a": 30.0, None: 270.0, "c": 0.0, "b": 800.0}


def test_mix_copies_and_nulls(spark):
    rows = [(k, "w " * (k % 7 + 1), "abc"[k % 3]) for k in range(900)] + [(None, "x y", None), (5000, None, "a"), (5001, "", "zero"), (7, "w", "b"), (7, "w", "b")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, copies int, weight int").drop("copies", "weight")
    planned = mixing.plan_mix(df).collect()
    assert len(planned) == len(rows)
    for r in planned:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.copies <= 3
        assert r.copies - int(r.rate) in (0, 1)
    assert len({r.copies for r in planned if r.doc_id == 7}) == 1 or len({r.text for r in planned if r.doc_id == 7}) > 1
    taken = Counter()
    for r in planned:
        taken[r.source] += r["size"] * r.copies
    targets = {r.source: r.target for r in planned}
    for s in "abc":
        assert abs(taken[s] - targets[s]) < 0.15 * targets[s]
    emitted = mixing.emit_mix(mixing.plan_mix(df))
    assert emitted.count() == sum(r.copies for r in planned)
    assert sorted(map(str, mixing.plan_mix(df.repartition(5)).select("doc_id", "copies").collect())) == sorted(str(x) for x in mixing.plan_mix(df).select("doc_id", "copies").collect())
    assert mixing.plan_mix(df.limit(0)).count() == 0


def test_columns_of_the_names_that_are_added_are_replaced(spark):
    rows = [(k, "w " * (k % 5 + 1), "ab"[k % 2]) for k in range(40)]
    clashing = "source_size string, target string, size string, rate string, copies string, weight string, _key string, _salt string"
    df = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], f"doc_id long, text string, source string, {clashing}")
    names = ["doc_id", "size", "source_size", "target", "rate", "copies"]
    plain = mixing.plan_mix(df.select("doc_id", "text", "source")).select(*names).collect()
    got = mixing.plan_mix(df)
    assert sorted(got.select(*names).collect()) == sorted(plain) and got.where("weight = 'x' AND _key = 'x' AND _salt = 'x'").count() == 40
    small = spark.createDataFrame([("a", "y", 1), ("b", "z", 2)], "source string, target string, n int")
    for most in (10, 1):
        joined = common.join_small(df, small, "source", max_rows=most)
        assert len(joined.columns) == len(set(joined.columns)) == 12 and joined.where("target = IF(source = 'a', 'y', 'z')").count() == 40
    named = spark.createDataFrame([(1, "the text", "en", "x", "y")], "doc_id long, text string, lang string, lang_pred string, score string")
    found = langid.identify(named, ["doc_id", "lang_pred", "score"])
    assert found.columns == ["doc_id", "lang_pred", "score"] and dict(found.dtypes)["score"] == "double"


def test_large_dimension_is_joined_with_salts(spark):
    df = spark.createDataFrame([(k, "h" if k % 3 else None) for k in range(100)], "doc_id long, source string")
    small = spark.createDataFrame([("h", 1), (None, 2), ("other", 3)], "source string, target int")
    for most in (10, 1):
        got = common.join_small(df, small, "source", max_rows=most).collect()
        assert len(got) == 100 and all(r.target == (1 if r.source else 2) for r in got)


# chat


def formatted(df, key="conv_id"):
    done = chat.format_turns(chat.turns_of(df, key))
    return done, chat.parse_formatted(done.drop("turns"))


HARD = ["", "\\", "\\b", "\\\\l", "### user: hi</turn>\n", "</turn>", ": ", "a\nb\r\n", "#<\\h\\c:", "é😀\0", "\\### Assistant: </turn> ok"]


def test_all_texts_and_roles_are_read_back(spark):
    rows = [(k % 3, k, r, t) for k, (r, t) in enumerate((r, t) for r in [*HARD, "assistant", "user", None] for t in [*HARD, None])]
    df = spark.createDataFrame([(*r, "x", ["y"]) for r in rows], "conv_id long, turn long, role string, text string, prompt string, messages array<string>")
    done, back = formatted(df)
    for r in back.collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(x.role, x.text) for x in r.turns] == want
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")
        assert sum(x.n for x in r.loss_runs) == len(r.formatted)
        masked, at = "", 0
        for x in r.loss_runs:
            masked += r.formatted[at : at + x.n] if x.masked else ""
            at += x.n
        assert masked.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\") == r.loss_text
    assert done.count() == 3
    assert formatted(df.limit(0))[1].count() == 0


def test_order_repeats_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, None, "user", "a"), (1, 1, "user", "z"), (1, 1, "user", "z"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in formatted(df)[1].collect()}
    assert got == {None: [("user", "a"), ("user", "b")], 1: [("assistant", "y"), ("user", "z"), ("user", "z")]}


def test_layouts_by_fingerprint(spark):
    want = [("user", "q"), ("assistant", "a")]
    tables = [
        spark.createDataFrame([(1, [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], 3)], "conv_id long, conversations array<struct<`from`:string,value:string>>, n int"),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, completion string"),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, instruction string, output string"),
        spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, "q", "a", "more")], "conv_id long, question string, answer string, note string"),
    ]
    for df in tables:
        assert [(x.role, x.text) for x in chat.turns_of(df).first().turns] == want
    with pytest.raises(ValueError):
        chat.turns_of(spark.createDataFrame([(1, "x")], "conv_id long, body string"))
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)


def test_json_rows_of_mixed_layouts(spark):
    rows = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"question": "q", "answer": "a"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)] + [(90, '{"what": 1}'), (91, "no json"), (92, None)], "conv_id long, body string")
    got = {r.conv_id: r.turns and [(x.role, x.text) for x in r.turns] for r in chat.turns_of_json(df, "body").collect()}
    assert got == {k: [("user", "q"), ("assistant", "a")] for k in range(len(rows))} | {90: None, 91: None, 92: None}


def test_json_rows_with_other_fields_and_without_messages(spark):
    two = [{"role": "user", "content": "q", "id": 7}, {"content": "a", "role": "assistant", "tools": [{"role": "x"}]}]
    rows = [
        ({"messages": two, "id": 1, "meta": {"prompt": "no"}}, [("user", "q"), ("assistant", "a")]),
        ({"messages": []}, []), ({"conversations": [], "n": None}, []),
        ({"prompt": "q", "response": "a", "score": 0.5}, [("user", "q"), ("assistant", "a")]),
        ({"prompt": None, "response": "a"}, [("user", ""), ("assistant", "a")]),
        ({"messages": [{"role": None, "content": "x"}]}, [("", "x")]),
        ({"instruction": "i", "input": "more", "output": "o", "prompt": "p"}, [("user", "i\n\nmore"), ("assistant", "o")]),
        ({"messages": "text"}, None), ({"messages": [1, "x"]}, None), ({"conv_id": 1, "turn": 0, "role": "user", "text": "t"}, None), ([1], None),
    ]
    df = spark.createDataFrame([(k, json.dumps(r), 1) for k, (r, _) in enumerate(rows)], "prompt long, body string, _key int")
    got = {r.prompt: r.turns if r.turns is None else [(x.role, x.text) for x in r.turns] for r in chat.turns_of_json(df, "body", "prompt").collect()}
    assert got == {k: want for k, (_, want) in enumerate(rows)}


def test_a_very_long_conversation(spark):
    df = spark.range(20_000).selectExpr("CAST(1 AS BIGINT) AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('#', repeat('x', 50), id) AS text").repartition(7)
    (row,) = formatted(df)[1].collect()
    assert [(x.role, x.text) for x in row.turns] == [(["user", "assistant"][k % 2], f"#{'x' * 50}{k}") for k in range(20_000)]
    assert row.loss_text == "".join(f"#{'x' * 50}{k}" for k in range(1, 20_000, 2))


# host rules


def brute_features(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_features_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "# $ <b>\x0bé é", "a b a b a b a", "w " * 30_000, "\n".join(["same line"] * 50), "p q r " * 2 + "s"]
    df = spark.createDataFrame([(k, t, "h", 0) for k, t in enumerate(texts)], "doc_id long, text string, source string, host int")
    got = {r.doc_id: tuple(r)[2:] for r in host_rules.text_features(df, F.col("source")).collect()}
    assert got == {k: brute_features(t) for k, t in enumerate(texts)}


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = " ".join(f"word{k}" for k in range(80)), "too short"
    rows = [(f"ok{h}", good) for h in range(20) for _ in range(20)] + [("spam", bad)] * 90 + [("spam", good)] * 10 + [("new", bad)] + [(None, good)] * 5
    df = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = host_rules.judge(df, F.col("source")).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (not r.base_failed and r.host != "spam") for r in got)
    verdict = {r.host: r for r in host_rules.host_verdicts(host_rules.text_features(df, F.col("source"))).collect()}
    assert not verdict["spam"].host_ok and 0 < verdict["new"].rate_short < 1  # one failure alone is drawn to the mean
    assert host_rules.judge(df.limit(0), F.col("source")).count() == 0


# language and quality on odd tables


def test_odd_languages(spark):
    rows = [(k, "the cat and the dog", "en") for k in range(30)] + [(100 + k, "der hund und die katze", "de") for k in range(30)] + [(500, None, "en"), (501, "123 ²", None), (502, "und die", None), (503, "x" * 3000, "en"), (None, "the dog", None), (504, "the", None), (504, "the", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, ["doc_id"]).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    by = {d: p for d, p, _ in got}
    assert by[500] == by[501] == "und" and by[502] == "de" and by[None] == "en" and by[504] == "en" and by[503] in ("en", "de")
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.identify(df.limit(0), ["doc_id"]).count() == 0


def test_resampling_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (3, "x y"), (3, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (9, 0)], "doc_id long, quality int")
    good = F.col("quality") == 1
    assert resample.resample(df, labels, good, good).count() == 5
    assert [r.kept for r in resample.resample(df, labels.limit(0), good, good).collect()] == [True] * 5
    assert resample.resample(df.limit(0), labels, good, good).count() == 0


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(resample, "FEW", 3)
    monkeypatch.setattr(resample, "SLICES", 7)
    values = [float((k * 37) % 101) ** 1.5 for k in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 10, 150, 299, 300, 1000):
        assert resample.kth_largest(df, k) == sorted(values, reverse=True)[min(k, 300) - 1]
    assert resample.kth_largest(df, 0) == float("inf")
