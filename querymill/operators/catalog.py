"""Tables as immutable Parquet generations behind one manifest, and the mutations that publish new ones.

A table is a folder: `gen=<n>/` Parquet folders, `staged/` deferred deltas and numbered manifests with the definition and the
published generation, of which the highest counts. Every mutation plans its key sets on the published generation, writes one
new generation and then renames the next manifest into place, so that a failed write is never seen. Files are reached through Hadoop's file system, so any
store that Spark writes to will do. There is one writer at a time.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import re
import threading
import uuid
from collections import OrderedDict
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querymill.plans.filters import Lowering, literal
from querymill.table import ColumnDef, RequestError, Table, validated


_RESULTS: OrderedDict[tuple, dict] = OrderedDict()


class Store:
    """Small text files and folders on Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def write(self, path: str, text: str) -> None:
        """A new file: written beside its place, then renamed into it whole."""
        new = f"{path}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._path(new), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(path) or not self.fs.rename(self._path(new), self._path(path)):
            self.fs.delete(self._path(new), False)
            raise OSError(f"cannot publish {path}")

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def manifests(self, folder: str) -> list[str]:
        """The whole manifests of a table, the one that counts last."""
        return [n for n in self.names(folder) if re.fullmatch(r"manifest-\d{12}\.json", n)]

    def write_manifest(self, folder: str, text: str) -> None:
        """Publish the next manifest; that before it stays, older ones go."""
        held = self.manifests(folder)
        number = int(held[-1][9:21]) + 1 if held else 0
        self.write(f"{folder}/manifest-{number:012d}.json", text)
        for name in held[:-1]:
            self.delete(f"{folder}/{name}")

    def read_manifest(self, folder: str) -> dict:
        return json.loads(self.read(f"{folder}/{self.manifests(folder)[-1]}"))


@dataclass(frozen=True)
class Definition:
    name: str
    columns: tuple[ColumnDef, ...]
    key: str
    aliases: tuple[str, ...] = ()

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.data_type(), True) for c in self.columns])

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(d: dict) -> Definition:
        return Definition(d["name"], tuple(ColumnDef(**c) for c in d["columns"]), d["key"], tuple(d["aliases"]))


class Catalog:
    """The tables below one folder."""

    _lock = threading.RLock()

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    # tables

    def create(self, definition: Definition) -> Table:
        with self._lock:
            names = {n.lower() for n in self._owned()}
            if any(n.lower() in names for n in (definition.name, *definition.aliases)):
                raise RequestError(f"the name {definition.name} or an alias is taken")
            empty = self.spark.createDataFrame([], definition.schema())
            validated(Table(definition.name, empty, {c.name: c for c in definition.columns}, definition.key))
            self.publish(definition, empty, 0)
            return self.table(definition.name)

    def _owned(self) -> dict[str, str]:
        out = {}
        for name in self.tables():
            d = Definition.from_json(self._manifest(name)["definition"])
            out |= {n: d.name for n in (d.name, *d.aliases)}
        return out

    def tables(self) -> list[str]:
        """The published tables; a folder without a manifest is of a writer that died before publishing."""
        return [n for n in self.store.names(self.store.root) if self.store.manifests(self.store.at(n))]

    def drop(self, name: str) -> None:
        with self._lock:
            self.store.delete(self.store.at(self.definition(name).name))

    def add_alias(self, name: str, alias: str) -> None:
        with self._lock:
            if alias.lower() in {n.lower() for n in self._owned()}:
                raise RequestError(f"the name {alias} is taken")
            d, m = self.definition(name), self._manifest(self.definition(name).name)
            self._write_manifest(replace(d, aliases=(*d.aliases, alias)), m["generation"])

    def definition(self, name: str) -> Definition:
        owned = {k.lower(): v for k, v in self._owned().items()}
        if name.lower() not in owned:
            raise RequestError(f"no table {name}")
        return Definition.from_json(self._manifest(owned[name.lower()])["definition"])

    def _manifest(self, name: str) -> dict:
        return self.store.read_manifest(self.store.at(name))

    def generation(self, name: str) -> int:
        return self._manifest(self.definition(name).name)["generation"]

    def table(self, name: str) -> Table:
        """The published generation: later mutations do not change it."""
        d = self.definition(name)
        path = self.store.at(d.name, f"gen={self._manifest(d.name)['generation']}")
        df = self.spark.read.schema(d.schema()).parquet(path)
        return Table(d.name, df, {c.name: c for c in d.columns}, d.key).prepared()

    def _write_manifest(self, d: Definition, generation: int) -> None:
        self.store.write_manifest(self.store.at(d.name), json.dumps({"generation": generation, "definition": d.to_json()}))

    def publish(self, d: Definition, df: DataFrame, generation: int) -> None:
        """Write rows as a new generation, and only then make it the one that is read."""
        path = self.store.at(d.name, f"gen={generation}")
        self.store.delete(path)  # left by a writer that died before publishing
        df.select(*[F.col(c.name).cast(c.data_type()).alias(c.name) for c in d.columns]).write.parquet(path)
        self._write_manifest(d, generation)

    def cached_aggregations(self, name: str, request: dict, filter_: dict | None = None, most: int = 128) -> dict:
        """Nested aggregations (see operators.buckets), kept by table, generation and request until a new generation is published."""
        from querymill.operators import buckets

        text = json.dumps([request, filter_], sort_keys=True, default=str)
        key = (self.store.root, self.definition(name).name, self.generation(name), hashlib.sha256(text.encode()).hexdigest())
        if key in _RESULTS:
            _RESULTS.move_to_end(key)
        else:
            _RESULTS[key] = buckets.nested(self.table(name), request, filter_)
            while len(_RESULTS) > most:
                _RESULTS.popitem(last=False)
        return _RESULTS[key]

    # mutations

    def _rows(self, table: Table, rows: list[dict]) -> DataFrame:
        """Typed rows in order of arrival (`__qm_at`); unknown columns and missing values of required ones are refused."""
        out = []
        for r in rows:
            for name in r:
                table.column(name)
            given = {table.column(k).name: v for k, v in r.items()}
            for c in table.columns.values():
                v = given.get(c.name)
                if v is None and (not c.nullable or c.name == table.key):
                    raise RequestError(f"column {c.name} needs a value")
                if v is not None and c.scalar not in ("json", "geo_point"):
                    for x in v if c.is_array else [v]:
                        literal(c, x)
            out.append(json.dumps({k: (json.dumps(v) if table.columns[k].kind == "json" else v) for k, v in given.items() if v is not None}))
        raw = self.spark.createDataFrame(list(enumerate(out)), "__qm_at long, __qm_json string")
        return typed_rows(raw, table).select("__qm_at", *table.columns)

    def insert(self, name: str, rows: list[dict]) -> None:
        self.batch([{"kind": "insert", "table": name, "row": r} for r in rows])

    def update(self, name: str, values: dict, filter_: dict, max_rows: int | None = None, dry_run: bool = False) -> int:
        return self.batch([{"kind": "update", "table": name, "values": values, "filter": filter_}], max_rows, dry_run)

    def delete(self, name: str, filter_: dict, max_rows: int | None = None, dry_run: bool = False) -> int:
        return self.batch([{"kind": "delete", "table": name, "filter": filter_}], max_rows, dry_run)

    def batch(self, mutations: list[dict], max_rows: int | None = None, dry_run: bool = False) -> int:
        """All mutations of one table or none. Filters are resolved on the published generation. Returns the rows touched."""
        with self._lock:
            owners = {self.definition(m["table"]).name for m in mutations}
            if len(owners) != 1:
                raise RequestError("a batch is of one table")
            table = self.table(owners.pop())
            df, touched = table.df, 0
            inserted = [m["row"] for m in mutations if m["kind"] == "insert"]
            if inserted:
                new = self._rows(table, inserted)
                twice = new.groupBy(table.key).count().where("count > 1").isEmpty() and new.join(table.df, table.key, "left_semi").isEmpty()
                if not twice:
                    raise RequestError("a key exists already")
                touched += len(inserted)
            for m in mutations:
                if m["kind"] == "insert":
                    continue
                hit = table.df.where(Lowering(table, scored=False).where(m["filter"])).select(table.key)
                n = hit.count()
                if max_rows is not None and n > max_rows:
                    raise RequestError(f"{n} rows match, {max_rows} are allowed")
                touched += n
                if m["kind"] == "delete":
                    df = df.join(hit, table.key, "left_anti")
                elif m["kind"] == "update":
                    df = self._updated(table, df, hit, m["values"])
                else:
                    raise RequestError(f"unknown mutation {m['kind']}")
            if inserted:
                df = df.select(*table.columns).unionByName(new.select(*table.columns))
            if not dry_run:
                self._next(table, df)
            return touched

    @staticmethod
    def _updated(table: Table, df: DataFrame, hit: DataFrame, values: dict) -> DataFrame:
        given = {table.column(k).name: v for k, v in values.items()}
        if table.key in given:
            raise RequestError("keys do not change")
        marked = df.join(hit.withColumn("__qm_hit", F.lit(True)), table.key, "left")
        for k, v in given.items():
            c = table.columns[k]
            if v is None and not c.nullable:
                raise RequestError(f"column {k} needs a value")
            new = F.lit(None) if v is None else F.from_json(F.lit(json.dumps(v)), c.data_type()) if c.is_array or c.kind == "geo_point" else F.lit(json.dumps(v)) if c.kind == "json" else literal(c, v)
            marked = marked.withColumn(k, F.when(F.col("__qm_hit"), new.cast(c.data_type())).otherwise(F.col(k)))
        return marked.select(*table.columns)

    def _next(self, table: Table, df: DataFrame) -> None:
        d = self.definition(table.name)
        self.publish(d, df, self._manifest(d.name)["generation"] + 1)

    def upsert(self, name: str, rows: list[dict] | DataFrame, deferred: bool = False) -> None:
        """Insert or replace by key; of rows with one key, the last counts. Deferred rows are seen after flush()."""
        with self._lock:
            table = self.table(name)
            new = self._rows(table, rows) if isinstance(rows, list) else rows
            if "__qm_at" not in new.columns:
                new = new.withColumn("__qm_at", F.monotonically_increasing_id())
            if deferred:
                at = len(self.store.names(self.store.at(table.name, "staged")))
                new.write.parquet(self.store.at(table.name, "staged", f"{at:08d}"))
            else:
                self._next(table, upserted(table, new))

    def flush(self, name: str) -> None:
        """Publish all deferred rows, in the order they came."""
        with self._lock:
            table = self.table(name)
            staged = self.store.at(table.name, "staged")
            parts = [self.spark.read.parquet(f"{staged}/{n}").withColumn("__qm_part", F.lit(k)) for k, n in enumerate(self.store.names(staged))]
            if parts:
                every = parts[0]
                for p in parts[1:]:
                    every = every.unionByName(p)
                self._next(table, upserted(table, every))
                self.store.delete(staged)  # replayed, not lost, if the writer dies before this

    def row_tags(self, name: str) -> DataFrame:
        """key, etag: a digest of each row by sorted column names, for optimistic concurrency."""
        table = self.table(name)
        return table.df.select(table.key, etag(table).alias("etag"))

    def update_if(self, name: str, key_value, tag: str, values: dict) -> None:
        """Update one row unless it changed since `tag` was read."""
        with self._lock:
            table = self.table(name)
            f = {"kind": "compare", "column": table.key, "operator": "equal", "value": key_value}
            found = table.df.where(Lowering(table, scored=False).where(f)).select(etag(table)).first()
            if found is None or found[0] != tag:
                raise RequestError("the row has changed")
            self.update(name, values, f)

    # schema

    def change(self, name: str, change: dict) -> None:
        """add_column, drop_column, rename_column or alter_column; the key stays, conversions are strict."""
        with self._lock:
            table, d = self.table(name), self.definition(name)
            kind = change["kind"]
            if kind == "add_column":
                c = change["column"]
                default = change.get("default")
                if default is None and not c.nullable:
                    raise RequestError("a required column needs a default")
                df = table.df.withColumn(c.name, (F.lit(None) if default is None else literal(c, default)).cast(c.data_type()))
                columns = (*d.columns, c)
            elif kind == "alter_document_store":
                return  # how rows are stored is Parquet's business
            else:
                old = table.column(change["from"] if kind == "rename_column" else change["column"])
                if old.name == d.key:
                    raise RequestError("the key stays as it is")
                if kind == "drop_column":
                    df, columns = table.df.drop(old.name), tuple(c for c in d.columns if c != old)
                elif kind == "rename_column":
                    df, columns = table.df.withColumnRenamed(old.name, change["to"]), tuple(replace(c, name=change["to"]) if c == old else c for c in d.columns)
                elif kind == "alter_column":
                    c = replace(change["definition"], name=old.name)
                    df = table.df.withColumn(old.name, F.col(old.name).cast(c.data_type()))  # ANSI: fails on what doesn't convert
                    if not c.nullable and not table.df.where(F.col(old.name).isNull()).isEmpty():
                        raise RequestError(f"column {old.name} holds nulls")
                    columns = tuple(c if x == old else x for x in d.columns)
                else:
                    raise RequestError(f"unknown change {kind}")
            new = replace(d, columns=columns)
            validated(Table(d.name, df, {c.name: c for c in columns}, d.key))
            self.publish(new, df, self._manifest(d.name)["generation"] + 1)

    def optimize(self, name: str, files: int = 8) -> None:
        """Rewrite the table in so many files, ordered by key within each."""
        with self._lock:
            table = self.table(name)
            self._next(table, table.df.repartitionByRange(files, table.key).sortWithinPartitions(table.key))

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Delete generations older than the last `keep`."""
        with self._lock:
            d = self.definition(name)
            last = self._manifest(d.name)["generation"]
            for n in self.store.names(self.store.at(d.name)):
                if n.startswith("gen=") and int(n[4:]) <= last - keep:
                    self.store.delete(self.store.at(d.name, n))


def typed_rows(raw: DataFrame, table: Table, skip: bool = False) -> DataFrame:
    """Adds the table's columns to rows with `__qm_json`, from request form: dates as text, blobs as hex, addresses as text.

    A value of another type fails the read, as one that is needed and missing does later; with `skip` their rows go.
    """
    shape = []
    for c in table.columns.values():
        as_text = c.scalar in ("date", "date_time", "timestamp", "blob", "ip")
        base = T.StringType() if as_text else c.data_type() if not c.is_array else c.data_type().elementType
        shape.append(T.StructField(c.name, T.ArrayType(base) if c.is_array else base))
    if skip:
        shape.append(T.StructField("__qm_bad", T.StringType()))
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__qm_bad"} if skip else {"mode": "FAILFAST"}
    parsed = raw.withColumn("__qm_row", F.from_json("__qm_json", T.StructType(shape), mode))

    @F.pandas_udf(T.BinaryType())
    def address(batch: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            try:
                a = ipaddress.ip_address(v)
            except ValueError:
                if skip:
                    return None
                raise
            return (ipaddress.IPv6Address(b"\0" * 10 + b"\xff\xff" + a.packed) if a.version == 4 else a).packed

        return batch.map(one)

    def converted(c: ColumnDef, v):
        if c.scalar == "blob":
            return F.unhex(F.regexp_replace(v, "^0x", ""))
        if c.scalar == "ip":
            return address(v)
        kind = c.data_type().elementType if c.is_array else c.data_type()
        return v.try_cast(kind) if skip else v.cast(kind)

    def column(c: ColumnDef):
        v = F.col(f"__qm_row.`{c.name}`")
        if not c.is_array:
            return converted(c, v)
        if c.scalar == "ip":
            raise RequestError("arrays of addresses are given as binary")
        return F.transform(v, lambda x: converted(c, x)) if c.scalar in ("date", "date_time", "timestamp", "blob") else v

    out = [column(c).alias(c.name) for c in table.columns.values()]
    typed = parsed.select(*[k for k in raw.columns], "__qm_row", *out)
    if skip:
        good = F.col("__qm_row.__qm_bad").isNull()
        for c in table.columns.values():
            v, given = F.col(c.name), F.col(f"__qm_row.`{c.name}`")
            good &= v.isNotNull() if not c.nullable or c.name == table.key else given.isNull() | v.isNotNull()
            if c.is_array:
                good &= F.coalesce(~F.exists(v, lambda x: x.isNull()), F.lit(True))
        typed = typed.where(good)
    return typed.drop("__qm_json", "__qm_row")


def upserted(table: Table, new: DataFrame) -> DataFrame:
    """The table with rows inserted or replaced by key; the last of a key by (__qm_part, __qm_at) counts."""
    by = [F.desc(c) for c in ("__qm_part", "__qm_at") if c in new.columns]
    last = new.withColumn("__qm_r", F.row_number().over(Window.partitionBy(table.key).orderBy(*by))).where("__qm_r = 1").select(*table.columns)
    return table.df.join(last.select(table.key), table.key, "left_anti").select(*table.columns).unionByName(last)


def etag(table: Table):
    return F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
