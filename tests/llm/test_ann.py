"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.llm import ann, queries


def brute(ids, vectors, asks, k):
    out = {}
    for q in asks:
        at = np.flatnonzero(ids == q)[0]
        s = (vectors * vectors[at]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 300)
    d = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = brute(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in queries.op7_nearest_neighbours(spark, d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        for _, v, s in found:
            assert v != q and abs(s - vectors[ids == v][0] @ vectors[ids == q][0]) < 1e-12
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.93


def test_odd_vectors_ties_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, [1.0]), (20, [0.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, v int")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_equal_vectors_are_salted(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 50)
    rng = np.random.default_rng(2)
    ids, vectors = np.arange(600), rng.standard_normal((600, 8))
    vectors[100:400] = vectors[100]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(ids, vectors, [i for i in ids if i % 20 == 0], 5)
    assert sum(len(set(got[q]) & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)
    assert got[120] == [v for v, _ in want[120]]


def test_blocks_meet_their_queries_in_many_partitions(spark, monkeypatch):
    """Also where several tasks share a block's queries, and where partitions are not put together."""
    monkeypatch.setattr(ann, "CELL_ROWS", 60)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    rng = np.random.default_rng(5)
    ids, vectors = np.arange(500), rng.standard_normal((500, 16))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(x) for x in names]
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "13")
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 5 == 0, k=5).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
    finally:
        for x, v in zip(names, before):
            spark.conf.set(x, v)
    want = brute(ids, vectors, [i for i in ids if i % 5 == 0], 5)
    assert sum(len(set(got.get(q, ())) & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)
