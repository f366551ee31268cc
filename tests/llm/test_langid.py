"""Language identification with many languages and with long letter runs."""

import random

import numpy as np

from querymill.llm import langid


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    rows, word = [], lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    for k in range(75):
        own = [word() for _ in range(6)]
        rows += [(f"l{k:02}", " ".join(rng.choice(own) for _ in range(12))) for _ in range(12 if k else 6)]
    df = spark.createDataFrame([(d, lang, text) for d, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    found = langid.identify(df, ["doc_id", "lang"]).collect()
    assert len(found) == len(rows)
    assert [r for r in found if r.lang != r.lang_pred] == []
    assert all(0.9 < r.score <= 1 for r in found)


def test_long_runs_are_counted_as_short_ones(monkeypatch):
    v = langid.Vocabulary(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "abab"])
    probs = np.append(np.random.default_rng(2).random(8), 0)[:, None]
    words, weights = ["ab" * 10, "abbaxab", "a", "xab" * 5], np.array([2.0, 1.0, 3.0, 5.0])
    want = langid.expected_counts(v, words, weights, probs)
    monkeypatch.setattr(langid, "BATCHED", 3)
    assert np.allclose(langid.expected_counts(v, words, weights, probs), want)
    monkeypatch.undo()
    lengths = np.array([len(p) for p in v.pieces] + [0])
    got = langid.expected_counts(v, ["ab" * 3000], np.array([2.0]), probs)
    assert np.isclose((got * lengths).sum(), 2 * 6001)


def test_a_language_of_long_runs_only_is_learned(spark):
    rng = random.Random(4)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [("long", run("的一是不了人我在有他", rng.randrange(25, 80))) for _ in range(40)]
    rows += [("short", " ".join(run("abcdef", 5) for _ in range(20))) for _ in range(40)]
    df = spark.createDataFrame([(d, lang, text) for d, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    found = langid.identify(df, ["doc_id", "lang"]).collect()
    assert len(found) == 80 and all(r.lang == r.lang_pred for r in found)
