"""Analyzers that run in Python, against plain Python."""

import tracemalloc

import pyarrow as pa

from querymill.functions.stemmer import stem_english
from querymill.functions.text import _per_token, analyze, fold_ascii, tokens

TEXTS = ["Running ponies, running cats", None, "", "Crème brûlée " * 30, "hopefully " + "x" * 50]


def test_stems_and_folds_equal_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    for analyzer in ({"stem": "english"}, {"custom": {"ascii_folding": True, "stem": "english"}}):
        got = dict(df.select("id", tokens(df.text, analyzer)).collect())
        assert got == {k: None if t is None else analyze(t, analyzer) for k, t in enumerate(TEXTS)}


def test_a_batch_of_tokens_stays_out_of_pythons_memory():
    run = _per_token(stem_english).func
    words = [f"walking{k}s" for k in range(500)]
    rows = [words] * 1000 + [None, [], ["ponies", None]]
    batch = pa.array(rows, pa.list_(pa.string()))
    tracemalloc.start()
    got = run(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000  # a list of half a million references takes four
    assert got.slice(999).to_pylist() == [[stem_english(w) for w in words], None, [], ["poni", None]]
    assert run(batch.slice(1000)).to_pylist() == got.slice(1000).to_pylist() and fold_ascii("é") == "e"
