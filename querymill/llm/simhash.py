"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment is mapped to its number of set bits. Each
bit that differs changes one count by at most one, so the Manhattan distance of two count vectors is a lower bound of
the fingerprints' Hamming distance. The range join goes over unit grids of half the axes: the axes form six groups, a
distance of three touches three groups at most, so two fingerprints within it share their grid cell on at least one of
the 20 triples of groups. In a cell the Manhattan bound is tested first, then the exact distance.

Only distinct fingerprints are joined, with the smallest id of each. A cell returns links that connect what is
connected in it, not all pairs: small cells are compared pair by pair, large ones by growing clusters, and very large
ones are first cut by each of four 16-bit blocks, of which near fingerprints share one.

Defined results: null or blank text has fingerprint 0 and links like any other; a null id keeps its fingerprint and takes
the component of it (null where no row with that fingerprint has an id); repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.bpe import chunks
from querymill.llm.common import materialize
from querymill.llm.graph import components

SEED = 42
WORDS = 3
DISTANCE = 3
GROUPS, SHARED = 6, 3
#: Cells up to this size are compared pair by pair; up to CUT, by growing clusters; larger ones are cut first.
PAIRWISE, CUT = 48, 20_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text's word shingles, as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest

    ws = text.translate(LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(ws) - words + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        a = starts[k : min(n, k + (1 << 15))].tolist()
        b = ends[k + min(words, len(ws)) - 1 :][: len(a)].tolist()
        h = np.fromiter((xxh64_intdigest(joined[x:y], seed) for x, y in zip(a, b)), np.uint64, len(a))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for part in chunks(batch.column("text")) for t in part], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """The 32 segment counts in two bits each, counted in unary (0, 1, 11): the bits that differ are the Manhattan distance."""
    low = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def cell_masks() -> list[int]:
    """For each triple of axis groups, the bits of its axes."""
    axes = np.array_split(np.arange(32), GROUPS)
    group = [sum(3 << 2 * int(a) for a in g) for g in axes]
    masks = [sum(group[g] for g in triple) for triple in combinations(range(GROUPS), SHARED)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _pairs(fp: np.ndarray, emb: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near fingerprints with the same key; rows are sorted by key."""
    left, right = [], []
    for d in range(1, len(key)):
        i = np.flatnonzero(key[d:] == key[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(emb[i] ^ emb[i + d]) <= DISTANCE]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= DISTANCE]
        left.append(i)
        right.append(i + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _grow(fp: np.ndarray, emb: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect each cluster of near fingerprints: every member is reached once."""
    links, rest = [], np.arange(len(fp))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(emb[rest] ^ emb[at]) <= DISTANCE
            near[near] = np.bitwise_count(fp[rest[near]] ^ fp[at]) <= DISTANCE
            found = rest[near].tolist()
            links += [(at, k) for k in found]
            queue += found
            rest = rest[~near]
    return links


def cell_links(fp: np.ndarray, emb: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs that connect what is connected in one large cell."""
    if len(fp) <= CUT:
        return _grow(fp, emb)
    links = []
    for block in range(4):
        part = (fp >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            links += [(int(rows[a]), int(rows[b])) for a, b in _grow(fp[rows], emb[rows])]
    return links


def _links_of(fp: np.ndarray, emb: np.ndarray, rep: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked representatives among rows sorted by key, of whole cells."""
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    sizes = np.diff(bounds)
    small = np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes)
    a, b = _pairs(fp[small], emb[small], key[small])
    out = [(rep[small][a], rep[small][b])]
    for k in np.flatnonzero(sizes > PAIRWISE):
        s = slice(bounds[k], bounds[k + 1])
        links = np.array(cell_links(fp[s], emb[s]), np.int64).reshape(-1, 2)
        out.append((rep[s][links[:, 0]], rep[s][links[:, 1]]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def grid_links(reps: DataFrame) -> DataFrame:
    """reps: fp, rep. Links a, b between representatives that connect all fingerprints within DISTANCE."""
    emb = embedding(F.col("fp"))
    cells = F.explode(F.array(*[F.xxhash64(F.lit(k), emb.bitwiseAND(F.lit(m))) for k, m in enumerate(cell_masks())]))
    keyed = reps.select("fp", emb.alias("emb"), "rep", cells.alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            a, b = _links_of(rows[0].view(np.uint64), rows[1].view(np.uint64), rows[2], rows[3])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            cuts = np.flatnonzero(np.diff(rows[3]))
            if held and len(rows[3]) and held[-1][3, -1] != rows[3, 0]:
                cuts = np.concatenate([[-1], cuts])
            if not len(cuts):
                held.append(rows)
                continue
            last = int(cuts[-1]) + 1
            if ready := [*held, rows[:, :last]]:
                yield emit(np.ascontiguousarray(np.concatenate(ready, axis=1)))
            held = [rows[:, last:]]
        if held:
            yield emit(np.ascontiguousarray(np.concatenate(held, axis=1)))

    return keyed.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over near fingerprints) of every row."""
    fps = materialize(fingerprints(docs, words))
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(grid_links(reps.where("rep is not null")))
    placed = reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(placed, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
