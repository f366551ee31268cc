"""Removal of repeated substrings by merged Burrows-Wheeler transforms.

A byte goes if it is covered by a string of MATCH bytes that also starts in a document with a smaller id. No pass sorts
the suffixes of the corpus:

0. Copies. Of equal texts (by SHA-256) that with the smallest id goes on; from the others everything goes. Texts under
   MATCH bytes keep everything. Both are decided without looking at windows.
1. Anchors. Every window of MATCH bytes has a minimizer, the least hash of its ANCHOR-byte strings; equal windows
   have equal minimizers. Texts are dealt to chunks, and a minimizer that only one document has rules its windows
   out. Hashes go to buckets and the shared ones come back to the chunks that asked.
2. Segments. A run of windows with one shared minimizer is cut out with its bytes (80 at most) and sent to the
   bucket of its minimizer, each distinct segment of a chunk once, with the smallest id that has it. Where a minimizer
   has more than HOT_SEGMENTS segments, single windows are sent instead, to the buckets of their own hashes, so that a
   passage with many different surroundings fills no bucket.
3. Transforms. In a bucket, segments with the same minimizers lie together in shards. Each shard gets the Burrows-
   Wheeler transform of its own segments (symbols are the STEP bytes before a suffix), and the shards' transforms are
   merged: from the interleave by the first h bytes, the stable order of the symbols gives that by h + STEP, until MATCH
   bytes are ordered. The blocks that never were told apart have a common prefix of MATCH bytes: the repeated
   intervals. Each takes the smallest id in it.
4. The intervals' ids go back to the chunks, which find their segments again in the same (sorted) order, and windows
   whose id is smaller than their document's are removed.

Steps 1 to 4 are one plan: the texts are shuffled once, by chunk, and that exchange serves steps 1, 2 and 4. Every table
between them is keyed by chunk or bucket, of sizes that do not depend on the keys' frequencies; hot strings are
combined within chunks before they are sent. Matches are compared on the input's bytes; hashes only rule windows out.

Defined results: null text is empty; texts under MATCH bytes lose nothing; a null id counts as larger than all; rows
that repeat an id take nothing from each other; an empty table gives an empty result. Columns of the input that are
called `kept`, `removed`, `_chunk`, `_digest`, `_first`, `_firsts` or `_many` go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from querymill.llm.common import join_small, materialize, tidied

MATCH, ANCHOR = 50, 20
SPAN = MATCH - ANCHOR + 1
LONGEST = MATCH + SPAN - 1
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
HOT_SEGMENTS = 512
#: Letters of segments merged at a time (below 65 536, so that symbols and ranks take two bytes), and bytes of a shard.
MERGE_BYTES, SHARD_BYTES = 60_000, 1 << 14
#: Letters ordered by one round of a merge.
STEP = 10
#: Text that minimizers are taken from at a time.
PASS_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max
#: Minimizers are sent as six bytes; more collisions would only mean more segments.
KEEP = np.uint64((1 << 48) - 1)
PRIME = 1099511628211
#: Bytes of a segment's row: its own, zeros, and its length as the last.
ROW = 88
#: A byte that UTF-8 never has ends a segment.
END = 255
SPANS = "array<struct<start:bigint,stop:bigint>>"


def _anchor_hashes(a: np.ndarray) -> np.ndarray:
    """64-bit hashes of all ANCHOR-byte strings."""
    h, size, grown = a.astype(np.uint64) + np.uint64(1), 1, {}
    grown[1] = h
    while size * 2 <= ANCHOR:
        h = h[:-size] * np.uint64(pow(PRIME, size, 1 << 64)) + h[size:]
        size *= 2
        grown[size] = h
    while size < ANCHOR:
        more = max(s for s in grown if s <= ANCHOR - size)
        n = len(a) - size - more + 1
        h = h[:n] * np.uint64(pow(PRIME, more, 1 << 64)) + grown[more][size : size + n]
        size += more
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h, size = np.minimum(h[:-size], h[size:]), size * 2
    return np.minimum(h[: -(width - size)], h[width - size :]) if size < width else h


def window_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """The runs of windows with one minimizer, for batches of texts.

    Gives (bytes, text number, start in the bytes, windows, minimizer, start of the batch in all texts).
    """
    k, before = 0, 0
    while k < len(texts):
        stop, size = k, 0
        while stop < len(texts) and (stop == k or size + len(texts[stop]) <= PASS_BYTES):
            size += len(texts[stop])
            stop += 1
        body = np.frombuffer(b"".join(texts[k:stop]), np.uint8)
        if len(body) >= MATCH:
            least = _sliding_least(_anchor_hashes(body), SPAN)
            ends = np.cumsum([len(t) for t in texts[k:stop]])
            starts = np.concatenate([[0], ends[:-1]])
            change = np.ones(len(least), bool)
            change[1:] = least[1:] != least[:-1]
            change[starts[starts < len(least)]] = True
            at = np.flatnonzero(change)
            text = np.searchsorted(ends, at, side="right")
            until = np.minimum(np.append(at[1:], len(least)), ends[text] - MATCH + 1)
            ok = until > at
            yield body, text[ok] + k, at[ok], (until - at)[ok], least[at[ok]] & KEEP, before
        k, before = stop, before + size


def _by(keys: np.ndarray):
    """(key, places) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(keys[part[0]]), part


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Places where a new key begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _six(h: np.ndarray) -> bytes:
    """The hashes' low six bytes."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _hashes(raw: list[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").reshape(-1)


def _coded(n: np.ndarray) -> np.ndarray:
    """Counts in seven bits: up to 63 as they are, above as the power of two that is not less."""
    return np.where(n < 64, n, 64 + np.ceil(np.log2(np.maximum(n, 1)))).astype(np.uint8)


def _decoded(code: np.ndarray) -> np.ndarray:
    return np.where(code < 64, code, np.int64(1) << np.minimum(np.maximum(code.astype(np.int64) - 64, 0), 40))


def segment_rows(body: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of ROW bytes for each segment of the body, as eight-byte numbers."""
    padded = np.concatenate([body, np.zeros(ROW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, ROW)[at]
    rows[np.arange(ROW)[None] >= sizes[:, None]] = 0
    rows[:, -1] = sizes
    return rows.view("<u8")


def row_bytes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments' bytes, one after the other, and their sizes."""
    raw = rows.view(np.uint8).reshape(-1, ROW)
    sizes = raw[:, -1]
    return raw[np.arange(ROW)[None] < sizes[:, None]], sizes


def row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h ^ column) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order that brings equal rows together, where each distinct row begins in it, the rows' hashes).

    The order is by hash, and by content where two rows share one, so it depends on the rows alone.
    """
    h = row_hashes(rows)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    if len(order) > 1:
        near = rows[order]
        new[1:] = h[order[1:]] != h[order[:-1]]
        differ = (near[1:] != near[:-1]).any(axis=1)
        if (differ & ~new[1:]).any():
            order = np.lexsort((*rows.T, h))
            near = rows[order]
            differ = (near[1:] != near[:-1]).any(axis=1)
        new[1:] = differ
    return order, np.flatnonzero(new), h


class Located:
    """The shared windows of a chunk's texts, as segments. Two calls on the same texts, in any order, number them alike."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, h: np.ndarray, hot: np.ndarray, n_buckets: int) -> None:
        order = np.argsort(h)
        h, hot = h[order], hot[order]
        parts = []
        for body, text, at, n, mark, before in window_runs(texts) if len(h) else ():
            where = np.searchsorted(h, mark)
            where[where == len(h)] = 0
            hit = np.flatnonzero(h[where] == mark)
            if not len(hit):
                continue
            text, at, n, mark, warm = text[hit], at[hit], n[hit], mark[hit], hot[where[hit]]
            size = np.where(warm, 1, SPAN)
            times = -(-n // size)
            offset = _within(times) * np.repeat(size, times)
            text, at, mark, warm = (np.repeat(x, times) for x in (text, at, mark, warm))
            windows = np.minimum(np.repeat(size, times), np.repeat(n, times) - offset)
            at = at + offset
            parts.append((segment_rows(body, at, windows + MATCH - 1), text, at + before, mark, warm))
        if not parts:
            parts = [(np.zeros((0, ROW // 8), "<u8"), *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64), np.zeros(0, bool))]
        rows, self.text, self.at, mark, warm = (np.concatenate(x) for x in zip(*parts))
        order, first, h = distinct_rows(rows)
        one = order[first]
        self.number = np.empty(len(rows), np.int64)
        self.number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        self.rows = rows[one]
        self.keys = np.where(warm[one], h[one] & KEEP, mark[one])
        self.ids = np.minimum.reduceat(ids[self.text[order]], first) if len(first) else np.zeros(0, np.int64)
        self.buckets = list(_by((self.keys % np.uint64(n_buckets)).astype(np.int64)))


def _ranked(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the first before the others, and each place's rank in it (equal for equal keys)."""
    by = None
    for key in reversed(keys):
        by = np.argsort(key, kind="stable") if by is None else by[np.argsort(key[by], kind="stable")]
    new = np.zeros(len(by), bool)
    for key in keys:
        near = key[by]
        new[1:] |= near[1:] != near[:-1]
    rank = np.empty(len(by), np.uint16 if len(by) <= 1 << 16 else np.uint32)
    rank[by] = np.cumsum(new)
    return by, rank


def shard_transforms(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shards' suffix orders and transforms, one shard after the other.

    Returns (symbols, order, shard sizes, segment of each suffix): suffixes are rotations of a segment with its end
    mark, `order` sorts those of each shard by their first MATCH letters, `symbols` are the STEP letters before them,
    numbered in their order.
    """
    raw, sizes = row_bytes(rows)
    sizes = sizes.astype(np.int64) + 1
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    letters = np.full(n, END, np.uint8)
    letters[inside] = raw
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    last = (ends - 1)[owner]
    here = np.arange(n)
    length = sizes[owner]

    def ahead(k: int) -> np.ndarray:
        at = here + k
        return np.where(at > last, at - length, at)

    pair = letters.astype(np.uint16) << 8 | letters[ahead(1)]
    _, gram = _ranked(pair, *[pair[ahead(k)] for k in range(2, STEP, 2)])
    shard = ((ends - 1) // SHARD_BYTES)[owner]
    shard = np.cumsum(np.concatenate([[0], shard[1:] != shard[:-1]])).astype(np.uint8 if shard[-1] - shard[0] < 256 else np.uint16)
    # order by shard, then the first STEP letters, then twice as many in each round
    by, rank = _ranked(shard, gram)
    deep = STEP
    while deep < MATCH:
        more = min(deep, MATCH - deep)
        by, rank = _ranked(rank, rank[ahead(more)])
        deep += more
    symbols = np.empty_like(gram)
    symbols[ahead(STEP)] = gram
    return symbols[by], by, np.bincount(shard), owner


def merge_transforms(symbols: np.ndarray, sizes: np.ndarray, depth: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards by their suffixes' first `depth` letters, and the block of equal prefixes at each place."""
    interleave = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint8 if len(sizes) <= 256 else np.uint16)
    block = np.zeros(len(symbols), np.int32)
    new = np.zeros(len(symbols), bool)
    for _ in range(depth // STEP):
        here = np.empty_like(symbols)
        here[np.argsort(interleave, kind="stable")] = symbols  # the next symbol of the shard whose turn it is
        order = np.argsort(here, kind="stable")
        interleave, here, block = interleave[order], here[order], block[order]
        new[1:] = (here[1:] != here[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new, dtype=np.int32)
    return interleave, block


def least_ids(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window of each segment, one after the other, the least id of the segments that hold it."""
    symbols, by, sizes, owner = shard_transforms(rows)
    interleave, block = merge_transforms(symbols, sizes)
    suffix = np.empty(len(by), np.int64)
    suffix[np.argsort(interleave, kind="stable")] = by
    out = np.empty(len(by), np.int64)
    out[suffix] = np.minimum.reduceat(ids[owner[suffix]], _firsts(block))[block]
    windows = rows.view(np.uint8).reshape(-1, ROW)[:, -1].astype(np.int64) + 1 - MATCH
    return out[np.repeat(np.cumsum(windows + MATCH) - windows - MATCH, windows) + _within(windows)]


def bucket_least_ids(rows: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one least id in each of a bucket's segments: how many, where they end, and the ids."""
    order = np.argsort(keys, kind="stable")
    rows, ids, keys = rows[order], ids[order], keys[order]
    windows = rows.view(np.uint8).reshape(-1, ROW)[:, -1].astype(np.int64) + 1 - MATCH
    letters = np.cumsum(windows + MATCH)
    groups = np.append(_firsts(keys), len(keys))
    low, begin = [], 0
    while begin < len(keys):
        # whole groups of one minimizer, as many as fit and one at least
        fits = np.searchsorted(letters, (letters[begin - 1] if begin else 0) + MERGE_BYTES, side="right")
        stop = int(groups[max(np.searchsorted(groups, fits, side="right") - 1, np.searchsorted(groups, begin, side="right"))])
        low.append(least_ids(rows[begin:stop], ids[begin:stop]))
        begin = stop
    flat = np.concatenate(low) if low else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), windows)
    last = np.ones(len(flat), bool)
    last[:-1] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(last)
    counts = np.bincount(owner[at], minlength=len(rows))
    until = at + 1 - (np.cumsum(windows) - windows)[owner[at]]
    # back to the order of the segments as given
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    take = np.repeat((np.cumsum(counts) - counts)[back], counts[back]) + _within(counts[back])
    return counts[back], until[take], flat[at][take]


def _texts(table: pa.Table, column: int) -> list[bytes]:
    return [x or b"" for x in table.column(column).cast(pa.binary()).to_pylist()]


def _made(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], names=list(kinds))


def _spans(counts: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))], names=["start", "stop"]))


def _shared_windows(docs: DataFrame, key: str, text: str, columns: list[str], total: int) -> DataFrame:
    """Steps 1 to 4 for distinct texts, with a `_digest` column: the columns, kept and removed."""
    n_chunks, n_buckets = max(1, math.ceil(total / CHUNK_BYTES)), max(1, math.ceil(total / BUCKET_BYTES))
    names = list(dict.fromkeys([*columns, key, text]))
    dealt = docs.select(*names, F.pmod(F.xxhash64("_digest"), F.lit(n_chunks)).alias("_chunk"))
    kinds = dict(docs.dtypes)
    own = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    place = {n: k for k, n in enumerate([*names, "_chunk"])}
    arrow_own = list(to_arrow_schema(docs.select(*columns).schema))
    answer = {"_chunk": pa.int64(), "_bucket": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
    answer_ddl = "_chunk long, _bucket long, a binary, b binary, c binary"

    def anchors(table: pa.Table) -> pa.Table:
        """By bucket: the chunk's distinct minimizers, and one byte each: segments that have it (coded) and, as a bit, several texts."""
        chunk, texts = table.column(place["_chunk"])[0].as_py(), _texts(table, place[text])
        parts = [(mark, number, at + before, np.minimum(n, SPAN)) for _, number, at, n, mark, before in window_runs(texts)]
        if not parts:
            return _made([], _bucket=pa.int64(), _chunk=pa.int64(), h=pa.binary(), n=pa.binary())
        mark, number, at, windows = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(mark, kind="stable")
        first = _firsts(mark[order])
        h, times = mark[order[first]], np.diff(np.append(first, len(order)))
        several = np.minimum.reduceat(number[order], first) != np.maximum.reduceat(number[order], first)
        n = np.ones(len(h), np.int64)
        many = np.flatnonzero(times > 1)
        again = order[np.repeat(first[many], times[many]) + _within(times[many])]
        group = np.repeat(many, times[many])
        content = row_hashes(segment_rows(np.frombuffer(b"".join(texts), np.uint8), at[again], windows[again] + MATCH - 1))
        by = np.lexsort((content, group))
        content, group = content[by], group[by]
        new = np.ones(len(by), bool)
        new[1:] = (content[1:] != content[:-1]) | (group[1:] != group[:-1])
        n[many] = np.bincount(group[new], minlength=len(h))[many]
        n = _coded(n) | (several.astype(np.uint8) << 7)
        return _made([(b, chunk, _six(h[p]), n[p].tobytes()) for b, p in _by((h % np.uint64(n_buckets)).astype(np.int64))], _bucket=pa.int64(), _chunk=pa.int64(), h=pa.binary(), n=pa.binary())

    def shared(table: pa.Table) -> pa.Table:
        """Back to each chunk: its minimizers that other chunks, or several of its texts, have too, and whether there are many segments."""
        raw, chunks_ = table.column("h").to_pylist(), np.array(table.column("_chunk").to_pylist())
        h, n = _hashes(raw), np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint8)
        chunk = np.repeat(chunks_, [len(x) // 6 for x in raw])
        order = np.argsort(h, kind="stable")
        first = _firsts(h[order])
        held = np.diff(np.append(first, len(h)))
        several = (np.maximum.reduceat(n[order] >> 7, first) > 0) | (held > 1) if len(h) else np.zeros(0, bool)
        many = np.add.reduceat(_decoded(n[order] & 127), first) > HOT_SEGMENTS if len(h) else np.zeros(0, bool)
        take, hot = order[np.repeat(several, held)], np.repeat(many[several], held[several])
        return _made([(c, None, _six(h[take[p]]), hot[p].tobytes(), None) for c, p in _by(chunk[take])], **answer)

    def located(table: pa.Table, marks: pa.Table) -> tuple[Located, list[bytes], np.ndarray]:
        ids = np.array([NO_ID if d is None else d for d in table.column(place[key]).to_pylist()], np.int64)
        texts = _texts(table, place[text])
        hot = np.frombuffer(b"".join(marks.column("b").to_pylist()), bool)
        return Located(texts, ids, _hashes(marks.column("a").to_pylist()), hot, n_buckets), texts, ids

    def segments(table: pa.Table, marks: pa.Table) -> pa.Table:
        """The chunk's distinct segments, by bucket."""
        kinds = {"_bucket": pa.int64(), "_chunk": pa.int64(), "body": pa.binary(), "sizes": pa.binary(), "ids": pa.binary(), "keys": pa.binary()}
        if not table.num_rows or not marks.num_rows:
            return _made([], **kinds)
        chunk = table.column(place["_chunk"])[0].as_py()
        x, _, _ = located(table, marks)
        out = []
        for b, part in x.buckets:
            raw, sizes = row_bytes(x.rows[part])
            out.append((b, chunk, raw.tobytes(), sizes.tobytes(), x.ids[part].tobytes(), _six(x.keys[part])))
        return _made(out, **kinds)

    def merge(table: pa.Table) -> pa.Table:
        """Back to each chunk: the runs of windows with one least id, of each of its segments in the order sent."""
        body, sizes, low, keys = (table.column(c).to_pylist() for c in ("body", "sizes", "ids", "keys"))
        ends = np.cumsum([len(x) for x in sizes])
        size = np.frombuffer(b"".join(sizes), np.uint8).astype(np.int64)
        rows = segment_rows(np.frombuffer(b"".join(body), np.uint8), np.cumsum(size) - size, size)
        ids, keys = np.frombuffer(b"".join(low), np.int64), _hashes(keys)
        order, first, _ = distinct_rows(rows)
        number = np.empty(len(rows), np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        one, least = order[first], np.minimum.reduceat(ids[order], first)
        counts, until, low = bucket_least_ids(rows[one], least, keys[one])
        begins, out = np.cumsum(counts) - counts, []
        for chunk, bucket, a, b in zip(table.column("_chunk").to_pylist(), table.column("_bucket").to_pylist(), [0, *ends[:-1]], ends):
            mine = number[a:b]
            take = np.repeat(begins[mine], counts[mine]) + _within(counts[mine])
            out.append((chunk, bucket, counts[mine].astype(np.uint8).tobytes(), until[take].astype(np.uint8).tobytes(), low[take].tobytes()))
        return _made(out, **answer)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_arrays([*[pa.array([], f.type) for f in arrow_own], pa.array([], pa.binary()), _spans(*(np.zeros(0, np.int64),) * 3)], names=[*columns, "kept", "removed"])
        is_mark = pa.array([x is None for x in answers.column("_bucket").to_pylist()], pa.bool_())
        x, texts, ids = located(table, answers.filter(is_mark))
        rest = answers.filter(pa.array([not v for v in is_mark.to_pylist()], pa.bool_()))
        found = {b: tuple(np.frombuffer(v, kind) for v, kind in zip(abc, (np.uint8, np.uint8, np.int64))) for b, *abc in zip(*(rest.column(c).to_pylist() for c in ("_bucket", "a", "b", "c")))}
        # runs of all segments, one bucket after the other
        counts, first = np.zeros(len(x.rows), np.int64), np.zeros(len(x.rows), np.int64)
        until, low, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for b, part in x.buckets:
            n, u, v = found[b]
            counts[part] = n
            first[part] = begin + np.cumsum(n, dtype=np.int64) - n
            begin += len(u)
            until.append(u.astype(np.int64))
            low.append(v)
        until, low = np.concatenate(until), np.concatenate(low)
        since = np.concatenate([[0], until[:-1]]) if len(until) else until
        since[first[counts > 0]] = 0
        n = counts[x.number]
        run = np.repeat(first[x.number], n) + _within(n)
        less = low[run] < np.repeat(ids[x.text], n)
        at, run = np.repeat(x.at, n)[less], run[less]
        body = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        step = np.zeros(len(body) + 1, np.int32)
        np.add.at(step, at + since[run], 1)
        np.subtract.at(step, at + until[run] + MATCH - 1, 1)
        out = np.cumsum(step, out=step)[:-1] > 0
        edge = np.zeros(len(body) + 1, bool)
        edge[ends] = edge[0] = True  # runs end where their text does
        edge[1:-1] |= out[1:] != out[:-1]
        at = np.flatnonzero(edge)
        a, b = at[:-1], at[1:]
        a, b = a[out[a]], b[out[a]]
        doc = np.searchsorted(ends, a, side="right")
        kept = np.concatenate([np.zeros(1, np.int32), np.cumsum(~out, dtype=np.int32)])[np.concatenate([[0], ends])]
        shape = [table.column(place[c]).combine_chunks() for c in columns]
        kept_bytes = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(body[~out].tobytes())])
        spans = _spans(np.bincount(doc, minlength=len(texts)), a - starts[doc], b - starts[doc])
        return pa.Table.from_arrays([*shape, kept_bytes, spans], names=[*columns, "kept", "removed"])

    hashed = dealt.groupBy("_chunk").applyInArrow(lambda table: tidied(anchors(table)), "_bucket long, _chunk long, h binary, n binary")
    marked = hashed.groupBy("_bucket").applyInArrow(shared, answer_ddl)
    cut = dealt.groupBy("_chunk").cogroup(marked.groupBy("_chunk")).applyInArrow(lambda table, marks: tidied(segments(table, marks)), "_bucket long, _chunk long, body binary, sizes binary, ids binary, keys binary")
    merged = cut.groupBy("_bucket").applyInArrow(lambda table: tidied(merge(table)), answer_ddl)
    return dealt.groupBy("_chunk").cogroup(marked.unionByName(merged).groupBy("_chunk")).applyInArrow(lambda table, answers: tidied(remove(table, answers)), f"{own}, kept binary, removed {SPANS}")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The columns asked for (all, if none are), `kept` (binary, the bytes that stay) and `removed` (array of start, stop: the maximal removed runs)."""
    docs = docs.drop("kept", "removed", "_chunk", "_digest", "_first", "_firsts", "_many")
    columns = docs.columns if columns is None else columns
    long = F.coalesce(F.octet_length(text), F.lit(0)) >= MATCH
    docs = docs.withColumn("_digest", F.when(long, F.unhex(F.sha2(text, 256))))
    # of each text over MATCH bytes: its bytes, its rows, its smallest id (null: only null ids), and the rows with that id
    by_id = docs.where(long).groupBy("_digest", key).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length(text)).alias("size"))
    known = materialize(
        by_id.groupBy("_digest").agg(F.sum("n").alias("n"), F.max("size").cast("long").alias("size"), F.min(F.struct(F.col(key).isNull(), F.col(key).alias("id"), F.col("n").alias("n"))).alias("first"))
        .select("_digest", "n", "size", F.col("first.id").alias("_first"), F.col("first.n").alias("_firsts"))
    )
    total = known.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    copies = known.where("n > 1").select("_digest", "_first", "_firsts")
    joined = join_small(docs, copies, "_digest")
    single = F.col("_firsts").isNull()
    is_first = F.col(key).eqNullSafe(F.col("_first"))
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    gone = ~single & ~is_first
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(text).cast("long").alias("stop")))
    decided = joined.where(~long | gone).select(
        *columns, F.when(gone, F.lit(b"")).otherwise(body).alias("kept"), F.when(gone, whole).otherwise(F.array()).cast(SPANS).alias("removed")
    )
    alone = joined.where(long & (single | (is_first & (F.col("_firsts") == 1))))
    if copies.where("_firsts > 1").isEmpty():
        return decided.unionByName(_shared_windows(alone, key, text, columns, total))
    # rows that repeat a text and its smallest id: searched once, and joined back with salts
    repeats = joined.where(long & is_first & (F.col("_firsts") > 1))
    once = repeats.select(key, text, "_digest").dropDuplicates(["_digest"])
    names = list(dict.fromkeys([*columns, key, text, "_digest"]))
    other = [c for c in names if c not in (key, text, "_digest")]
    types = dict(joined.dtypes)
    rows = alone.select(*names, F.lit(False).alias("_many")).unionByName(once.select(key, text, "_digest", *[F.lit(None).cast(types[c]).alias(c) for c in other], F.lit(True).alias("_many")))
    found = materialize(_shared_windows(rows, key, text, [*dict.fromkeys([*columns, "_digest"]), "_many"], total))
    again = join_small(repeats.select(*dict.fromkeys([*columns, "_digest"])), found.where("_many").select("_digest", "kept", "removed"), "_digest", max_rows=-1)
    wanted = [*columns, "kept", "removed"]
    return decided.unionByName(found.where("NOT _many").select(*wanted)).unionByName(again.select(*wanted))
