"""What the operators of this subpackage share: words, written intermediates, joins with small tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of one row per source or host is broadcast; a larger one is joined by salted shuffle.
BROADCAST_ROWS = 100_000
#: Salts that a larger table is repeated over, so that one hot key is dealt to as many tasks.
SALTS = 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset (tests), below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-querymill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/querymill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them again: lineage ends there and lost executors cost no rework."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """At the end of a task: return freed memory, for a Python worker lives on and serves other operators."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(result):
    """A task's result, after the memory that it took to make has been given back."""
    give_back()
    return result


class HashTable:
    """Places of distinct 64-bit keys: an open table, searched for many keys at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = np.ascontiguousarray(keys).view(np.uint64)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.places[slot] < 0
            self.places[slot[free]] = rest[free]
            lost = self.places[slot] != rest
            rest, slot = rest[lost], (slot[lost] + 1) & (1 << self.bits) - 1
        held = self.places >= 0
        self.keys[held] = keys[self.places[held]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' places, -1 where there is none."""
        keys = np.ascontiguousarray(keys).view(np.uint64).reshape(-1)
        slot = self._slot(keys)
        out = self.places[slot]
        rest = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        out[rest] = -1
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (1 << self.bits) - 1
            found = self.places[slot[rest]]
            hit = (found >= 0) & (self.keys[slot[rest]] == keys[rest])
            out[rest[hit]] = found[hit]
            rest = rest[~hit & (found >= 0)]
        return out


def let(value: Column, body) -> Column:
    """body(v) with v computed once, also where body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_small(df: DataFrame, small: DataFrame, key: str, how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join `small` (one row per value of `key`, null included) to `df` on a null-safe key.

    Columns of `small` replace those of `df` that have their names.

    Broadcast if `small` is counted to have at most `max_rows` rows; otherwise `small` is repeated over SALTS
    salts and shuffled, so that a value that holds a third of `df` is spread over SALTS tasks.
    """
    added = [c for c in small.columns if c != key]
    small = small.select(F.col(key).alias("__small_key"), *[F.col(f"`{c}`").alias(f"__small_{k}") for k, c in enumerate(added)])
    if small.limit(max_rows + 1).count() <= max_rows:
        joined = df.join(F.broadcast(small), df[key].eqNullSafe(small["__small_key"]), how)
    else:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(SALTS)).cast("int")
        left = df.withColumn("__salt", salt)
        right = small.withColumn("__small_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(right, left[key].eqNullSafe(right["__small_key"]) & (left["__salt"] == right["__small_salt"]), how)
    kept = [df[f"`{c}`"] for c in df.columns if c not in added]
    return joined.select(*kept, *[F.col(f"__small_{k}").alias(c) for k, c in enumerate(added)])
