"""Backup and restore of a catalog: one copied generation per table and a manifest of digests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from querymill.operators.catalog import Catalog, Store, etag
from querymill.table import RequestError, Table


def _digest(table: Table) -> dict:
    """Rows and an order-free digest of a table's rows."""
    row = table.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(etag(table), 1, 15), 16, 10).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": row["n"], "digest": str(row["sum"])}


def backup(catalog: Catalog, path: str) -> dict:
    out = Store(catalog.spark, path)
    manifest = {}
    for name in catalog.tables():
        generation = catalog.generation(name)
        catalog.table(name).df.write.parquet(out.at(name, f"gen={generation}"))
        out.write_manifest(out.at(name), json.dumps({"generation": generation, "definition": catalog.definition(name).to_json()}))
        manifest[name] = _digest(catalog.table(name))
    out.write(out.at("backup.json"), json.dumps(manifest))
    return manifest


def restore(catalog: Catalog, path: str, force: bool = False) -> None:
    """Verify all of a backup, then publish each table as a new generation; existing tables need force.

    Executors copy the rows. A table that exists keeps its published generation until the copy is whole.
    """
    source = Catalog(catalog.spark, path)
    manifest = json.loads(source.store.read(source.store.at("backup.json")))
    held = catalog.tables()
    if held and not force:
        raise RequestError("the catalog is not empty")
    for name, expected in manifest.items():
        if _digest(source.table(name)) != expected:
            raise RequestError(f"the backup of {name} is damaged")
    for name in manifest:
        catalog.publish(source.definition(name), source.table(name).df, catalog.generation(name) + 1 if name in held else 0)
