"""Repeated substrings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from querymill.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.01"


def brute_gone(rows):
    """rows: (id, text). For each, its bytes and whether each goes."""
    least = {}
    bodies = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in bodies:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, d), d)
    for d, b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        yield b, gone


def brute_kept(rows):
    return [bytes(c for c, g in zip(b, gone) if not g) for b, gone in brute_gone(rows)]


def brute(rows):
    """rows: (id, text). Per row: bytes, removed, runs and kept digest."""
    out = []
    for (name, _), (b, gone) in zip(rows, brute_gone(rows)):
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((name, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    out = []
    for r in suffix_dedup.deduplicate(df).collect():
        kept, n = bytes(r.kept), len((r.text or "").encode())
        assert sum(x.stop - x.start for x in r.removed) == n - len(kept)
        out.append((r.doc_id, n, n - len(kept), len(r.removed), hashlib.sha256(kept).hexdigest()))
    return out


def test_op4_equals_brute_force_on_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op4_suffix_dedup(spark, SF).collect()) == sorted(brute(docs))


@pytest.mark.parametrize("hot", [0, 512])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_copies(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 9000)
    monkeypatch.setattr(suffix_dedup, "PASS_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 300)
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcé \n\0", k=rng.randint(40, 120))) for _ in range(12)] + ["a" * 130, "ab" * 60]
    rows = [(rng.choice([None, *range(40)]), "".join(rng.choice([*pool, "".join(rng.choices("xyz", k=30))]) for _ in range(rng.randint(0, 6)))) for _ in range(60)]
    rows += [(7, None), (8, ""), (9, "short"), (3, pool[0] * 9), (3, pool[0] * 9), (11, "a" * 9000), (12, "a" * 49), (13, "a" * 50)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, kept int, _chunk string")
    assert sorted(result(df), key=repr) == sorted(brute(rows), key=repr)


def test_nothing(spark):
    assert suffix_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert result(spark.createDataFrame([(1, None)], "doc_id long, text string")) == brute([(1, None)])


def test_merge_orders_all_windows():
    rng = random.Random(4)
    strings = list({bytes(rng.choices(b"ab", k=rng.randint(50, 80))) for _ in range(300)})
    ids = np.array(rng.choices(range(1000), k=len(strings)), np.int64)
    least = {}
    for s, i in zip(strings, ids.tolist()):
        for k in range(len(s) - 49):
            least[s[k : k + 50]] = min(i, least.get(s[k : k + 50], i))
    sizes = np.array([len(s) for s in strings])
    rows = suffix_dedup.segment_rows(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert suffix_dedup.least_ids(rows, ids).tolist() == [least[s[k : k + 50]] for s in strings for k in range(len(s) - 49)]


def test_equal_hashes_do_not_join_different_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "row_hashes", lambda rows: np.zeros(len(rows), np.uint64))
    body = np.frombuffer(b"".join(bytes([65 + k % 3]) * 60 for k in range(9)), np.uint8)
    rows = suffix_dedup.segment_rows(body, np.arange(9) * 60, np.full(9, 60))
    order, first, _ = suffix_dedup.distinct_rows(rows)
    assert len(first) == 3 and all((rows[order[a]] == rows[order[a + 1]]).all() for a in first)


def test_rows_that_repeat_the_smallest_id_of_a_text(spark):
    """Also where all of them have no id; other columns stay each row's own."""
    text, other = "one passage of more than fifty bytes, which some rows repeat; ", "another passage of more than fifty bytes altogether. "
    rows = [(None, other, 1), (None, other, 2), (4, text + other, 3), (4, text + other, 4), (9, text + other, 5), (2, text, 6), (2, text, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    found = suffix_dedup.deduplicate(df).collect()
    want = {x: b[2:] for x, b in zip(range(1, 8), brute([r[:2] for r in rows]))}
    assert {r.extra: (len(r.text.encode()) - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in found} == want
    assert suffix_dedup.deduplicate(df, columns=["extra"]).columns == ["extra", "kept", "removed"]
