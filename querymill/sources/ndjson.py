"""NDJSON import: plain, gzip or zstd lines (by file name), upserted into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators.catalog import Catalog, typed_rows
from querymill.table import RequestError, Table


def read_lines(spark: SparkSession, path: str, table: Table, on_error: str = "abort") -> DataFrame:
    """Typed rows of the lines, in order (`__qm_at`).

    Lines that aren't objects, hold unknown columns, lack the key or a needed value, or hold a value of another type are
    errors. abort: an error fails the read. skip: such lines are left out.
    """
    if on_error not in ("abort", "skip"):
        raise RequestError("on_error is abort or skip")
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("__qm_at"), F.col("value").alias("__qm_json"))
    names = F.json_object_keys("__qm_json")
    good = names.isNotNull() & (F.size(F.array_except(names, F.array(*map(F.lit, table.columns)))) == 0) & F.get_json_object("__qm_json", f"$.{table.key}").isNotNull()
    good = F.coalesce(good, F.lit(False))
    if on_error == "abort":
        checked = raw.withColumn("__qm_json", F.when(good, F.col("__qm_json")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.substring("__qm_json", 1, 200)))))
    else:
        return typed_rows(raw.where(good), table, skip=True)
    return typed_rows(checked, table)


def import_file(catalog: Catalog, name: str, path: str, on_error: str = "abort", deferred: bool = False) -> int:
    """Upsert a file into a table, all or nothing; the lines' order decides between rows of one key. Returns the lines taken."""
    return import_report(catalog, name, path, on_error, deferred)["accepted"]


def import_report(catalog: Catalog, name: str, path: str, on_error: str = "abort", deferred: bool = False) -> dict[str, int]:
    """The same, with the numbers of lines taken and left out."""
    rows = read_lines(catalog.spark, path, catalog.table(name), on_error)
    lines, n = catalog.spark.read.text(path).where(F.trim("value") != "").count(), rows.count()
    catalog.upsert(name, rows, deferred)
    return {"accepted": n, "rejected": lines - n}


def read_flattened(spark: SparkSession, path: str, columns: dict[str, tuple[str, str | list[str]]]) -> DataFrame:
    """Flat rows of nested objects, one a line. columns: name -> (type, path or paths).

    One path is a field that each object must have; it may be null. Several make an array of the values that are there, in the
    paths' order: `a` is a field that may lack, `a[]` all items of an array and `a[].b` a field of each item, and these arrays
    each object must have. Values that are null or of another type are left out of arrays, and null elsewhere. Lines that are no
    objects fail the read.
    """
    line = F.when(F.json_object_keys("value").isNotNull(), F.try_parse_json("value")).otherwise(_bad("not an object", F.col("value")))
    rows = spark.read.text(path).where(F.trim("value") != "").select(line.alias("__qm_object"), "value")
    return rows.select(*[_flat("__qm_object", *how).alias(name) for name, how in columns.items()])


def _bad(what: str, line: Column) -> Column:
    return F.raise_error(F.concat(F.lit(what + ": "), F.substring(line, 1, 200)))


def _each(items: Column, path: str, kind: str) -> Column:
    return F.transform(items, lambda x: F.try_variant_get(x, path, kind))


def _flat(at: str, kind: str, paths: str | list[str]) -> Column:
    whole = F.col(at)
    if isinstance(paths, str):
        there = F.try_variant_get(whole, f"$.{paths}", "variant").isNotNull()
        return F.when(there, F.try_variant_get(whole, f"$.{paths}", kind)).otherwise(_bad(f"no {paths}", F.col("value")))
    parts = []
    for p in paths:
        head, items, leaf = p.partition("[]")
        if not items:
            parts.append(F.array(F.try_variant_get(whole, f"$.{p}", kind)))
            continue
        found = F.try_variant_get(whole, f"$.{head}", "array<variant>")
        taken = _each(found, "$" + leaf, kind)
        parts.append(F.when(found.isNotNull(), taken).otherwise(_bad(f"{head} is no array", F.col("value"))))
    return F.array_compact(F.concat(*parts))


def write_results(df: DataFrame, path: str) -> None:
    """A result as NDJSON files."""
    df.write.json(path)
