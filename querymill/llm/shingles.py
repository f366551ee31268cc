"""Near-duplicates by the exact Jaccard similarity of word shingles.

A text's set of word shingles (64-bit hashes) has a key, the hash of the sorted set; texts with equal sets are one node.
Candidates come from operator 5, whose grid join links fingerprints of the same shingles that differ in three bits, and,
because most sets at a similarity of 0.8 differ in more (ten of 64 on average), from 40 bands of five minimum hashes: sets at
0.8 share no band with a chance of 1.3e-7, and closer ones with less. What shares a band is linked to the band's least key,
and what shares a fingerprint to the fingerprint's, which gives loose components without listing pairs. Each loose component's sets then go to one task, or, where they hold over BLOCK shingles, block by block to a task
for each pair of blocks; there exact similarities are counted, and clusters grown so that every member is reached once.
Only links of at least the asked similarity are returned.

Defined results: texts of fewer words than a shingle have one shingle of all of them; null and blank texts have the empty
set, and are equal to each other and near nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.bpe import chunks
from querymill.llm.common import give_back, materialize
from querymill.llm.graph import components
from querymill.llm.simhash import LOWER, SEED, fingerprint, grid_links

WORDS = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 40, 5
#: Shingles of a block; a task holds two blocks at most, or the sets of two longer texts.
BLOCK = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's word shingles."""
    from xxhash import xxh64_intdigest

    ws = text.translate(LOWER).split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxh64_intdigest(w, SEED) for w in ws), np.uint64, len(ws))
    size = min(words, len(ws))
    n = len(ws) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * BASE + h[k : k + n]
    return np.unique(_mix(out))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash for each band of minimum hashes; none for the empty set."""
    if not len(shingles):
        return shingles
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(least, (FACTORS[:, None] * shingles[None, k : k + 512]).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mix(out * BASE + column)
    return out


def keys(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, h (hash of the text), key and size of the shingle set, its bands, and the text's fingerprint."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, found = [], []
            for t in (t for part in chunks(batch.column("text")) for t in part):
                s = shingle_set(t, words)
                found.append((xxh64_intdigest(s.tobytes(), SEED), len(s), bands(s).view(np.int64)))
                prints.append(fingerprint(t, words))
            offsets = np.concatenate([[0], np.cumsum([len(b) for _, _, b in found])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *[b for _, _, b in found]])
            key, fp = (np.array(x, np.uint64).view(np.int64) for x in ([k for k, _, _ in found], prints))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(key), pa.array([n for _, n, _ in found], pa.int64()), pa.array(fp), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "h", "key", "size", "fp", "bands"],
            )
        give_back()

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, key long, size long, fp long, bands array<long>")


def similar_pairs(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Index pairs of similarity `least` or more that connect all such pairs: every member of a cluster is reached once."""
    size = np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(codes, kind="stable")
    held, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(codes))])
    ends = np.cumsum(size)
    top, bottom = least
    links, alive = [], np.ones(len(sets), bool)
    for seed in range(len(sets)):
        queue = [seed] if alive[seed] else []
        alive[seed] = False
        while queue:
            at = queue.pop()
            own = codes[ends[at] - size[at] : ends[at]]
            spans = first[own + 1] - first[own]
            places = np.repeat(first[own] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            common = np.bincount(held[places], minlength=len(sets))
            near = np.flatnonzero(alive & (common * (top + bottom) >= top * (size + size[at])) & (common > 0))
            alive[near] = False
            links += [(at, k) for k in near.tolist()]
            queue += near.tolist()
    return links


def simhash_links(found: DataFrame) -> DataFrame:
    """Links a, b between keys that connect all with fingerprints within three bits of each other."""
    prints = materialize(found.select("fp", "key").distinct())
    reps = materialize(prints.groupBy("fp").agg(F.min("key").alias("rep")))
    same = prints.join(reps, "fp").where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    return same.union(grid_links(reps))


def loose_components(found: DataFrame) -> DataFrame:
    """node, component of all keys that share a band with another, or lie near it by fingerprint, over both."""
    banded = materialize(found.select("key", F.explode("bands").alias("band")).distinct())
    shared = banded.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    links = banded.join(shared.select("band", "low"), "band").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    rest = materialize(components(links.union(simhash_links(found))))
    return rest.union(rest.select("component", "component").distinct())


def near_links(docs: DataFrame, found: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, h, text; found: their keys. Links a, b between keys whose sets are similar, that connect all such keys."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    reps = found.groupBy("key").agg(F.min(row).alias("row"), F.min("size").alias("size"))
    members = materialize(loose_components(found).join(reps, F.col("node") == F.col("key")).select("component", "key", "size", "row.doc_id", "row.h"))
    blocks = members.groupBy("component").agg(F.ceil(F.sum("size") / F.lit(block)).cast("int").alias("n"))
    place = F.pmod(F.xxhash64("key"), F.col("n")).cast("int")
    other = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: (k != F.col("block")) | (F.col("n") == 1))
    cells = F.transform(other, lambda k: F.xxhash64("component", F.least("block", k), F.greatest("block", k)))
    placed = members.join(blocks, "component").withColumn("block", place).select("key", F.col("doc_id").alias("_id"), F.col("h").alias("_h"), cells.alias("cells"))
    texts = docs.join(placed, docs["doc_id"].eqNullSafe(placed["_id"]) & (docs["h"] == placed["_h"])).select("key", "cells", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).tobytes() for part in chunks(batch.column("text")) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("cells"), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["key", "cells", "shingles"])
        give_back()

    def link(cell: pa.Table) -> pa.Table:
        # rows that repeat have the same key
        sets = dict(zip(cell.column("key").to_pylist(), (np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist())))
        names = sorted(sets)
        pairs = np.array(similar_pairs([sets[k] for k in names]), np.int64).reshape(-1, 2)
        at = np.array(names, np.int64)
        return pa.table({"a": at[pairs[:, 0]], "b": at[pairs[:, 1]]})

    made = texts.mapInArrow(make, "key long, cells array<long>, shingles binary")
    return made.select("key", "shingles", F.explode("cells").alias("cell")).groupBy("cell").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, h, key and component (a key, the same for all that similar sets connect) of every row of docs: doc_id, h, text."""
    found = materialize(keys(docs, words))
    roots = components(near_links(docs, found, words, block))
    return found.join(roots, found["key"] == roots["node"], "left").select("doc_id", "h", "key", F.coalesce("component", "key").alias("component"))
