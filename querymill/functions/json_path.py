"""Typed access to paths of JSON text columns through variants."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.table import RequestError, Table

#: Path types and the Spark types they are read as.
PATH_TYPES = {"string": "string", "i64": "bigint", "u64": "decimal(20,0)", "f64": "double", "bool": "boolean", "date_time": "timestamp"}
NUMERIC = ("i64", "u64", "f64")
_observed: dict[tuple, frozenset[str]] = {}


def json_column(table: Table, name: str) -> str:
    c = table.indexed(name)
    if c.kind != "json":
        raise RequestError(f"column {c.name} is not a JSON column")
    return c.name


def _path(path: str) -> str:
    if not path or not all(re.fullmatch(r"\w+", p) for p in path.split(".")):
        raise RequestError(f"bad JSON path {path!r}")
    return "$." + path


def variant_at(table: Table, name: str, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(F.col(json_column(table, name))), _path(path), "variant")


def typed(table: Table, name: str, path: str, data_type: str) -> Column:
    """The path's value as the given type, after checking that the column holds that type there and no other."""
    if data_type not in PATH_TYPES:
        raise RequestError(f"unknown path type {data_type}")
    check_type(table, name, path, data_type)
    return F.try_variant_get(F.try_parse_json(F.col(json_column(table, name))), _path(path), PATH_TYPES[data_type])


def observed_types(table: Table, name: str, path: str) -> frozenset[str]:
    """The scalar types found at the path; one row for each reaches the driver, once for a table."""
    key = (table.df.semanticHash(), name, path)
    if key not in _observed:
        kinds = table.df.select(F.schema_of_variant(variant_at(table, name, path)).alias("kind")).where("kind IS NOT NULL").distinct().collect()
        if len(_observed) > 1000:
            _observed.clear()
        _observed[key] = frozenset(re.sub(r"\(.*", "", r["kind"]) for r in kinds) - {"VOID"}
    return _observed[key]


def check_type(table: Table, name: str, path: str, data_type: str) -> None:
    allowed = {
        "string": {"STRING"}, "i64": {"BIGINT"}, "u64": {"BIGINT", "DECIMAL"}, "f64": {"DOUBLE", "DECIMAL", "BIGINT", "FLOAT"}, "bool": {"BOOLEAN"}, "date_time": {"STRING", "TIMESTAMP"},
    }[data_type]
    found = observed_types(table, name, path)
    if found - allowed:
        raise RequestError(f"{name}.{path} holds {', '.join(sorted(found))}, not {data_type}")
