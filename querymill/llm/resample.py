"""Quality by importance resampling.

Two generative models over hashed word n-grams (unigrams and bigrams, BUCKETS buckets) are counted: the raw one over all
documents, the target one over a bounded sample of documents labelled good. A document's log importance weight is the
log ratio of its probabilities under the two. Adding Gumbel noise, seeded by the document's id, and taking the k
largest sums samples k documents without replacement in proportion to their weights.

Defined results: null text has no n-grams and weight 1 (log 0); rows that repeat an id have the same noise; ties at the
k-th place all stay; without labels every weight is 1 and all documents stay; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.bpe import chunks
from querymill.llm.common import materialize
from querymill.llm.mixing import unit_hash

BUCKETS = 10_000
#: Labelled good documents that the target model is fitted on, at most about.
TARGET_ROWS = 20_000
SEED = 11
#: Slices that a range of keys is counted in, and slices this small are looked at key by key.
SLICES, FEW = 4096, 2000


def buckets_of(text: bytes) -> np.ndarray:
    """Buckets of the text's words and word pairs (ASCII lower case)."""
    h = np.fromiter(map(crc32, text.lower().split()), np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)
    return np.concatenate([h % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS)]).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """N-grams of all documents in each bucket; each task sends BUCKETS sums, and so many reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in chunks(batch.column("text")):
                for t in part:
                    total += np.bincount(buckets_of(t), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def target_sample(docs: DataFrame, labels: DataFrame, good: Column, rows: int = TARGET_ROWS) -> tuple[DataFrame, float]:
    """Documents of about `rows` (all, if fewer) of the labels that are good, by hash of the id."""
    ids = labels.where(good & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    n = ids.count()
    draw = F.pmod(F.xxhash64(F.lit("target"), "doc_id"), F.lit(1_000_000)) < min(1.0, rows / max(n, 1)) * 1_000_000
    return docs.join(F.broadcast(ids.where(draw)), "doc_id", "left_semi"), n


def log_weights(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and key (with Gumbel noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [float(shared.value[buckets_of(t)].sum()) for part in chunks(batch.column("text")) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "log_weight"])

    noise = -F.log(-F.log((unit_hash(F.col("doc_id"), seed) * 2**52 + 0.5) / float(2**52)))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_weight double").withColumn("key", F.col("log_weight") + noise)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of `key`, by counting ever narrower slices; at most SLICES counts or FEW keys reach the driver."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k <= 0:
        return math.inf
    if k >= n:
        return low
    while low < high:
        inside = keys.where(F.col("key").between(low, high))
        width = (high - low) / SLICES
        place = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(SLICES - 1)) if width > 0 else F.lit(0)
        counts = inside.groupBy(place.alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("slice")).collect()
        for r in counts:
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
        if r["n"] <= FEW:
            return sorted((x[0] for x in keys.where(F.col("key").between(low, high)).select("key").collect()), reverse=True)[k - 1]
    return low


def resample(docs: DataFrame, labels: DataFrame, good: Column, target: Column, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, key and kept: the documents' share that `good` labels have (or `share`), drawn by weight.

    target: the labels whose documents the target model is fitted on.
    """
    raw = bucket_counts(docs)
    sample, _ = target_sample(docs.select("doc_id", "text"), labels, target)
    wanted = bucket_counts(sample)
    ratio = np.log((wanted + 1) / (wanted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)) if wanted.sum() else np.zeros(BUCKETS)
    if share is None:
        n, n_good = labels.agg(F.count(F.lit(1)), F.count_if(good)).first()
        share = n_good / n if n and wanted.sum() else 1.0
    weighted = materialize(log_weights(docs, ratio))
    return weighted.withColumn("kept", F.col("key") >= F.lit(kth_largest(weighted, round(share * weighted.count()))))
