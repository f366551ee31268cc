"""Each stage of the pipeline against brute force on its own input, and odd rows through all of them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from querymill.llm import bpe, langid, mixing, queries, resample
from querymill.llm.common import materialize

from .test_shingles import brute_groups
from .test_suffix_dedup import brute_kept

SF = "/root/testdata/sf0.01"


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = []
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF))
        after.append({r.doc_id: r for r in docs.collect()} if stage is not cp.encode else docs.collect())
    lang, near, sub, _, coded = after
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(lang) == {d for d, r in docs.items() if any(c.isalpha() for c in r.text)}
    assert all(r.text == docs[d].text and r.source == docs[d].source for d, r in lang.items())
    ids = sorted(lang)
    groups = brute_groups([lang[d].text for d in ids])
    assert set(near) == {ids[k] for k in range(len(ids)) if groups[k] == k}
    ids = sorted(near)
    assert set(sub) == set(ids)
    for d, kept in zip(ids, brute_kept([(d, near[d].text) for d in ids])):
        assert sub[d].text == kept.decode("utf-8", "ignore") and sub[d].n_chars == len(sub[d].text)
    # copies by the targets' arithmetic, and their ids by the library
    copies = brute_copies([(r.doc_id, r.text, r.source) for r in sub.values()])
    assert Counter(r.doc_id for r in coded) == +Counter(copies)
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    for r in coded:
        want = tok.encode(sub[r.doc_id].text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(want, skip_special_tokens=False).encode()).hexdigest()


def brute_copies(rows):
    """rows: (doc_id, text, source). How often the mix takes each, by filling targets a source at a time."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    held = Counter()
    for d, _, source in rows:
        held[source] += size[d]
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(sorted(held))}
    target, free, left = {}, set(held), float(sum(held.values()))
    while free:
        share = left / sum(weight[x] for x in free)
        full = {x for x in free if weight[x] * share > 3 * held[x]}
        if not full:
            target |= {x: weight[x] * share for x in free}
            break
        target |= {x: 3.0 * held[x] for x in full}
        free -= full
        left -= sum(3 * held[x] for x in full)
    out = {}
    for d, _, source in rows:
        rate = min(target[source] / held[source], 3.0) if held[source] else 0.0
        u = int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / 2**52
        out[d] = int(rate) + (u < rate - int(rate))
    return out


def test_odd_rows(spark):
    long = "word and other things " * 4000
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, None, None, None, None), (None, "a text without an id", "en", None, 3), (3, "", "en", "s", 0), (4, "12 34 !!", "en", "s", 8), (5, long, "en", "t", 1), (6, "é" * 300, "fr", "s", 2), (7, "x " + "é" * 300, "fr", "s", 2)]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, _chunk int")
    for _, stage in cp.STAGES:
        assert (stage(spark, docs.limit(0), SF)).count() == 0
        out = materialize(stage(spark, docs, SF))
        if stage is cp.identify_language:
            assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 1, 5, 6, 7]
        if stage is cp.drop_near_duplicates:
            assert sorted(r.doc_id or 0 for r in out.collect())[:2] == [0, 1]
    docs = materialize(docs)
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF))


def test_language_model_sums_all_segmentations():
    v = langid.Vocabulary(["▁", "a", "b", "ab", "▁a", "ba", "▁ab"])
    rng = np.random.default_rng(1)
    probs = np.concatenate([rng.random((7, 2)), np.zeros((1, 2))])

    def brute(w, k):
        if not w:
            return 1.0
        total = sum(probs[v.place[w[:n]], k] * brute(w[n:], k) for n in range(1, len(w) + 1) if w[:n] in v.place)
        return total + (langid.UNKNOWN * brute(w[1:], k) if w[0] not in v.place else 0)

    words = ["a", "ab", "abba", "bab", "axb", "ab" * 20]
    got = langid.Model(["x", "y"], probs, v).scores(words)
    assert np.allclose(got, [[np.log(brute("▁" + w, k)) for k in range(2)] for w in words[:5]] + [got[5]])
    assert np.isfinite(got[5]).all()
    short = langid.Model(["x", "y"], probs, v)._long("▁abba")
    assert np.allclose(short, got[2])
    uses = langid.expected_counts(v, ["abba"], np.array([2.0]), probs[:, :1])
    lengths = np.array([len(p) for p in v.pieces] + [0])
    assert np.isclose((uses * lengths).sum(), 2 * 5)  # every segmentation covers all five letters


def test_op10_is_right_on_held_out_documents(spark):
    found = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_op3_equals_brute_force(spark):
    """Weights from n-gram counts, Gumbel keys from the ids' hashes, and the rows kept, in plain Python over all documents."""
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()

    def grams(text):
        words = [zlib.crc32(w) for w in "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) for b in text).encode("latin-1").split()]
        mix = lambda a, b: ((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93 & 2**64 - 1) >> 33
        return [w % resample.BUCKETS for w in words] + [mix(a, b) % resample.BUCKETS for a, b in zip(words, words[1:])]

    raw, wanted = Counter(), Counter()
    target = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    held = {k: grams(t) for k, t in docs.items()}
    for k, g in held.items():
        raw.update(g)
        if k in target:
            wanted.update(g)
    n_raw, n_wanted = sum(raw.values()) + resample.BUCKETS, sum(wanted.values()) + resample.BUCKETS
    weight = {k: math.fsum(math.log((wanted[x] + 1) / n_wanted) - math.log((raw[x] + 1) / n_raw) for x in g) for k, g in held.items()}
    unit = lambda k: int(hashlib.md5(f"{resample.SEED}:{k}".encode()).hexdigest()[:13], 16)
    key = {k: w - math.log(-math.log((unit(k) + 0.5) / 2**52)) for k, w in weight.items()}
    good = sum(r.quality == 1 for r in labels)
    kept = set(sorted(key, key=key.get, reverse=True)[: round(good / len(labels) * len(docs))])
    found = queries.op3_importance_resample(spark, d).collect()
    assert {r.doc_id for r in found} == set(docs)
    for r in found:
        assert math.isclose(r.log_weight, weight[r.doc_id], rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r.gumbel_key, key[r.doc_id], rel_tol=1e-9, abs_tol=1e-6)
    assert {r.doc_id for r in found if r.kept} == kept


def test_op3_keeps_good_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = queries.op3_importance_resample(spark, d).join(labels, "doc_id").collect()
    kept = lambda q: [r.kept for r in found if r.quality == q]
    assert np.mean(kept(1)) > 0.95 and np.mean(kept(0)) < 0.1
    again = {r.doc_id: r.kept for r in queries.op3_importance_resample(spark, d).collect()}
    assert all(again[r.doc_id] == r.kept for r in found)
