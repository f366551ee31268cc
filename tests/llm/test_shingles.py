"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from querymill.llm import shingles

SF = "/root/testdata/sf0.01"


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute_groups(texts):
    """texts: a list. The group of each, as the least place in it."""
    sets = [brute_set(t) for t in texts]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    group = list(range(len(texts)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    seen = {}
    for k, s in enumerate(sets):
        near = [j for j, n in Counter(j for x in s for j in holders[x] if j < k).items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
        near += [seen[s]] if s in seen else []
        seen.setdefault(s, k)
        for j in near:
            a, b = sorted((root(j), root(k)))
            group[b] = a
    return [root(k) for k in range(len(texts))]


def near_copies(seed, n, words, changed):
    """n texts, each with a few runs of a common text's words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randrange(changed + 1)):
            ws[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


def test_stage_keeps_one_of_each_group_of_similar_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10**6 + k, t) for k, t in enumerate(t for seed in range(60) for t in near_copies(seed, 4, 150 + 3 * seed, 5))]
    docs.sort(key=lambda r: r[0])
    groups = brute_groups([t for _, t in docs])
    want = {d for k, (d, _) in enumerate(docs) if groups[k] == k}
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_duplicates(spark, df, SF).collect()
    assert len(got) == len(want) and {r.doc_id for r in got} == want


def test_blocks_of_a_large_component_lose_no_link(spark):
    texts = near_copies(7, 60, 200, 6) + ["", None, "a b", "A  B"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) AS h")
    groups = brute_groups(texts)
    for block in (10**6, 3000, 100):
        by = defaultdict(set)
        for r in shingles.near_duplicates(df, block=block).collect():
            by[r.component].add(r.doc_id)
        assert sorted(map(sorted, by.values())) == sorted([j for j in range(len(texts)) if groups[j] == k] for k in set(groups))
    assert 1 < len(set(groups[:60])) < 60
    assert shingles.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_decided_each_in_its_own_group(spark):
    a, b, c = (near_copies(s, 1, 100, 0)[0] for s in (1, 2, 3))
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (2, b + " more"), (3, c), (4, c), (None, c), (None, c)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, df, SF).collect()]
    assert Counter(d for d, _ in got) == {1: 1, 2: 1, 3: 1, None: 2}
    assert next(t for d, t in got if d == 2).startswith(b)
