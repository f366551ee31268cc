"""The training-data pipeline over `documents`: language ID, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from querymill.llm import bpe, langid, mixing, shingles, suffix_dedup
from querymill.llm.common import materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less sure than this go, with those of no language.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay, and lang is the one found."""
    found = langid.identify(docs.select(*COLUMNS), COLUMNS)
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return found.where(sure).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest doc_id; of rows that repeat it, one.

    Near copies have five-word shingles with a Jaccard similarity of 0.8 or more; groups are connected by them. Rows that
    share a doc_id but not a group are decided each in its own. Rows without an id stay.
    """
    docs = docs.select(*COLUMNS).withColumn("h", F.xxhash64("text"))
    found = materialize(shingles.near_duplicates(docs.select("doc_id", "h", "text")))
    known = found.where("doc_id IS NOT NULL")
    first = known.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    out = known.join(first, "component").where(F.struct("doc_id", "h") != F.col("first")).select("doc_id", "h").distinct()
    repeated = materialize(known.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "h"))
    kept = docs.join(out, ["doc_id", "h"], "left_anti")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    single = kept.join(repeated, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return kept.join(repeated, ["doc_id", "h"], "left_anti").select(*COLUMNS).unionByName(single.select(*COLUMNS))


@F.pandas_udf(StringType())
def valid_text(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has go; parts of characters at the cuts go with them."""
    found = suffix_dedup.deduplicate(docs.select(*COLUMNS))
    whole = F.size("removed") == 0
    cut = valid_text(F.when(~whole, F.col("kept")))  # null, and so not sent to Python as text, where nothing was removed
    text = F.when(whole, F.col("text")).otherwise(cut)
    return found.withColumn("text", text).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; copies repeat the row."""
    return mixing.emit_mix(mixing.plan_mix(docs.select(*COLUMNS))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with digests of the ids and of the text they decode to."""
    coded = bpe.encode(docs.select(*COLUMNS), decoded=True)
    return coded.select("doc_id", "lang", "source", "ids", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_substrings),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: No stage but the mix can be put in SQL (trained model, bit counts of hashes, merges): tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
