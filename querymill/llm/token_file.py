"""Token-ID files of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id, encoded, ended with END_ID, and packed into shard images of about
SHARD_IDS ids, written as rows (shard, n_ids, image) of a table in shared storage. An image is

    "QMT1", n_ids u64, n_docs u64, n_blocks u64
    block starts u64 * (n_blocks + 1), from the first block
    blocks: min u32, width u8, n u16, n_exceptions u16, packed u64 * (4 * width), exception places u8, exceptions u32
    document lengths u32 * n_docs, document ids i64 * n_docs, id present u8 * n_docs

A block holds 256 ids less their minimum in `width` bits, the width of their PERCENTILE-th percentile; ids that need
more bits stand in the exception list. The block starts give any id without reading those before it.

Defined results: null text is empty and gives END_ID alone; null ids come first; rows that repeat an id lie next to
each other, by text; an empty table gives no shards.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm.bpe import chunks, coder, tokenizer_path
from querymill.llm.common import join_small, materialize

END_ID = 2
BLOCK = 256
PERCENTILE = 90
SHARD_IDS = 1 << 20
HEAD = struct.Struct("<4sQQQ")
BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u2"), ("exceptions", "<u2")])


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the counts, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of the ids in order, and the n + 1 starts of the blocks."""
    n = len(ids)
    rows = -(-n // BLOCK)
    if not rows:
        return b"", np.zeros(1, "<u8")
    padded = np.concatenate([ids, np.full(rows * BLOCK - n, ids[-1], ids.dtype)]).astype(np.uint64).reshape(rows, BLOCK)
    low = padded.min(axis=1)
    rest = padded - low[:, None]
    mark = np.partition(rest, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]
    width = np.ceil(np.log2(mark.astype(np.float64) + 1)).astype(np.int64)
    block, place = np.nonzero(rest >> width[:, None].astype(np.uint64))
    exceptions = np.bincount(block, minlength=rows)
    heads = np.zeros(rows, BLOCK_HEAD)
    heads["low"], heads["width"], heads["n"], heads["exceptions"] = low, width, BLOCK, exceptions
    heads["n"][-1] = n - (rows - 1) * BLOCK
    starts = np.concatenate([[0], np.cumsum(BLOCK_HEAD.itemsize + 32 * width + 5 * exceptions)])
    out = np.empty(int(starts[-1]), np.uint8)
    out[starts[:-1, None] + np.arange(BLOCK_HEAD.itemsize)] = heads.view(np.uint8).reshape(rows, -1)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        packed = _pack(rest[at].reshape(-1, 64), w).view(np.uint8).reshape(len(at), 32 * w)
        out[(starts[at] + BLOCK_HEAD.itemsize)[:, None] + np.arange(32 * w)] = packed
    after = starts[:-1] + BLOCK_HEAD.itemsize + 32 * width
    out[_places(after, exceptions)] = place
    out[_places(after + exceptions, 4 * exceptions)] = rest[block, place].astype("<u4").view(np.uint8)
    return out.tobytes(), starts.astype("<u8")


def _pack(values: np.ndarray, w: int) -> np.ndarray:
    out = np.zeros((len(values), w), "<u8")
    low = values & np.uint64((1 << w) - 1)
    for k in range(64 if w else 0):
        word, shift = divmod(k * w, 64)
        out[:, word] |= low[:, k] << np.uint64(shift)
        if shift + w > 64:
            out[:, word + 1] |= low[:, k] >> np.uint64(64 - shift)
    return out


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    out = np.zeros((len(words), 64), np.uint64)
    for k in range(64 if w else 0):
        word, shift = divmod(k * w, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + w > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = x & np.uint64((1 << w) - 1)
    return out


def image_of(ids: np.ndarray, lengths: list[int], doc_ids: list[int | None]) -> bytes:
    blocks, starts = pack_blocks(ids)
    present = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([HEAD.pack(b"QMT1", len(ids), len(lengths), len(starts) - 1), starts.tobytes(), blocks, np.array(lengths, "<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), present.tobytes()])


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """All ids, the documents' lengths and their ids."""
    magic, n_ids, n_docs, n_blocks = HEAD.unpack_from(image)
    if magic != b"QMT1":
        raise ValueError("not a token image")
    ids = read_ids(image, 0, n_ids)
    at = HEAD.size + 8 * (n_blocks + 1)
    at += int(np.frombuffer(image, "<u8", 1, at - 8)[0])
    lengths = np.frombuffer(image, "<u4", n_docs, at)
    names = np.frombuffer(image, "<i8", n_docs, at + 4 * n_docs)
    present = np.frombuffer(image, np.uint8, n_docs, at + 12 * n_docs)
    return ids, lengths, [int(d) if p else None for d, p in zip(names, present)]


def read_ids(image: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of an image, from the blocks that hold them alone."""
    _, _, _, n_blocks = HEAD.unpack_from(image)
    if start >= stop:
        return np.zeros(0, "<u4")
    base, first, last = HEAD.size + 8 * (n_blocks + 1), start // BLOCK, (stop - 1) // BLOCK
    starts = np.frombuffer(image, "<u8", n_blocks + 1, HEAD.size)[first : last + 2].astype(np.int64)
    body = np.frombuffer(image, np.uint8, int(starts[-1] - starts[0]), base + int(starts[0]))
    starts = starts[:-1] - starts[0]
    heads = body[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)].view(BLOCK_HEAD).reshape(-1)
    out = np.zeros((len(starts), BLOCK), np.uint64)
    width, exceptions = heads["width"].astype(np.int64), heads["exceptions"].astype(np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        words = body[(starts[at] + BLOCK_HEAD.itemsize)[:, None] + np.arange(32 * w)].reshape(-1).view("<u8")
        out[at] = _unpack(words.reshape(4 * len(at), w), w).reshape(len(at), BLOCK)
    after = starts + BLOCK_HEAD.itemsize + 32 * width
    block, place = np.repeat(np.arange(len(starts)), exceptions), body[_places(after, exceptions)]
    out[block, place] = body[_places(after + exceptions, 4 * exceptions)].view("<u4")
    out += heads["low"].astype(np.uint64)[:, None]
    return out.reshape(-1)[start - first * BLOCK : stop - first * BLOCK].astype("<u4")


def write_token_files(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> DataFrame:
    """Encode doc_id, text, write the shards in ascending doc_id order, and return the written table."""
    path = path or tokenizer_path()
    end = struct.pack("<I", end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, lengths, names, size, c = TaskContext.get().partitionId() << 32, [], [], [], 0, coder(path)

        def flush() -> pa.RecordBatch:
            image = image_of(np.frombuffer(b"".join(ids), "<u4"), lengths, names)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([size], pa.int64()), pa.array([image], pa.binary())], names=["shard", "n_ids", "image"])

        for batch in batches:
            k = 0
            for part in chunks(batch.column("text")):
                for coded in c.encode(part):
                    ids.append(coded + end)
                    lengths.append(len(coded) // 4 + 1)
                    names.append(batch.column("doc_id")[k].as_py())
                    size += lengths[-1]
                    k += 1
                    if size >= shard_ids:
                        yield flush()
                        shard, ids, lengths, names, size = shard + 1, [], [], [], 0
        if lengths:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(pack, "shard long, n_ids long, image binary"))


def shard_starts(shards: DataFrame) -> DataFrame:
    """shard and the ids before it. Sums go over the shards of a partition, then over one row for each partition."""
    rows = shards.select("shard", "n_ids", F.shiftright("shard", 32).alias("part"))
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = rows.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids"))
    return within.join(before, "part").select("shard", (F.col("before") + F.col("inside")).alias("shard_start"))


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of every document, from the written images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, image in zip(batch.column("shard"), batch.column("image")):
                ids, lengths, names = read_image(image.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.tobytes())
                for k in range(0, len(lengths), 4096):
                    part = slice(k, k + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[part], pa.int64()),
                            pa.array([shard.as_py()] * len(names[part]), pa.int64()),
                            pa.array(ends[part] - lengths[part]),
                            pa.array(lengths[part].astype(np.int64)),
                            pa.array([bytes(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends[part].tolist(), lengths[part].tolist())], pa.binary()),
                        ],
                        names=["doc_id", "shard", "inside", "n_tokens", "ids"],
                    )

    found = shards.select("shard", "image").mapInArrow(run, "doc_id long, shard long, inside long, n_tokens long, ids binary")
    placed = join_small(found, materialize(shard_starts(shards)), "shard")
    return placed.select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids")
