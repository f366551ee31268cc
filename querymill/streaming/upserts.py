"""Streaming upserts: files that arrive are merged into a table, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querymill.operators.catalog import Catalog


def upsert_stream(catalog: Catalog, name: str, rows: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that upserts a stream of typed rows. A batch that is replayed after a failure gives the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        catalog.upsert(name, batch.withColumn("__qm_at", F.monotonically_increasing_id()))

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def parquet_stream(catalog: Catalog, name: str, path: str) -> DataFrame:
    """Parquet files of a folder, as they come, in the table's schema."""
    return catalog.spark.readStream.schema(catalog.definition(name).schema()).parquet(path)


def windowed_counts(rows: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Rows per window and key of a stream with a watermark; rows later than `late` are dropped by it."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("doc_count"))
