"""SimHash fingerprints and components against brute force."""

import re

import numpy as np
from xxhash import xxh64_intdigest

from querymill.llm import graph, queries, simhash

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    h = [xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), seed=42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fp). Breadth first over distinct fingerprints."""
    fps = np.array(sorted({f for _, f in rows}), np.uint64)
    least = {}
    for d, f in rows:
        if d is not None:
            least[f] = min(least.get(f, d), d)
    out, todo = {}, set(range(len(fps)))
    while todo:
        group, queue = set(), [todo.pop()]
        while queue:
            k = queue.pop()
            group.add(k)
            near = [j for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 3).tolist() if j in todo]
            todo.difference_update(near)
            queue += near
        low = min((least[int(fps[k])] for k in group if int(fps[k]) in least), default=None)
        out |= {int(fps[k]): low for k in group}
    return {(d, f, out[f]) for d, f in rows}


def test_op5_equals_brute_force_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([(d.doc_id, brute_fingerprint(d.text)) for d in docs])
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op5_simhash_components(spark, SF).collect()]
    assert len(got) == len(docs) and set(got) == want


def test_odd_texts(spark):
    rows = [(5, None), (4, ""), (9, " \t\n"), (None, "a b c"), (7, "A B C"), (6, "a b"), (6, "a b"), (3, "x " * 70_000)]
    df = spark.createDataFrame([(d, t, "extra", 1) for d, t in rows], "doc_id long, text string, fp string, rep int")
    got = sorted(map(repr, ((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())))
    known = [(d, brute_fingerprint(t)) for d, t in rows]
    expected = brute_components(known)
    by_row = {(d, f): c for d, f, c in expected}
    assert got == sorted(repr((d, f, by_row[d, f])) for d, f in known)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_grid_loses_no_link_and_large_cells_connect(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(40):
            bits = rng.choice(64, rng.integers(0, 5), replace=False)
            fps.add(c ^ sum(1 << int(b) for b in bits))
    fps |= {int(centres[0]) ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # 2016 in one cluster
    rows = list(enumerate(sorted(fps)))
    rng.shuffle(rows)
    want = {(d, c) for d, _, c in brute_components([(int(d), int(f)) for d, f in rows])}
    df = spark.createDataFrame([(int(f) - 2**64 if f >= 2**63 else int(f), int(d)) for d, f in rows], "fp long, rep long")
    for cut in (20_000, 100):
        monkeypatch.setattr(simhash, "CUT", cut)
        links = simhash.grid_links(df)
        assert links.count() < 40 * len(rows)
        roots = {r.node: r.component for r in graph.components(links).collect()}
        assert {(int(d), roots.get(int(d), int(d))) for d, _ in rows} == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 200)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (7, 6)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 201)} | {k: 1000 for k in range(1001, 1200)}
