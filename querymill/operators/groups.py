"""Tabular aggregation: count, sum, average, min and max by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.table import RequestError, Table

FUNCTIONS = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}


def aggregate(table: Table, function: str, column: str | None) -> Column:
    if function == "count":
        if column is None or table.column(column).name == table.key:
            return F.count(F.lit(1))
        return F.count(F.col(table.column(column).name))
    if function not in FUNCTIONS or column is None:
        raise RequestError(f"bad aggregate {function}")
    c = table.column(column)
    if c.kind not in ("integer", "real"):
        raise RequestError(f"{function} takes an integer or real column, not {c.name}")
    return FUNCTIONS[function](F.col(c.name)).cast("double")


def tabular(table: Table, projection: list[dict], group_by: list[str], order_by: list[dict], limit: int, offset: int, max_groups: int | None = None) -> DataFrame:
    """Groups (null is one) with their aggregates. Without an order, the largest groups first, then by key.

    More groups than max_groups are an error; without it there is no bound, for groups are shuffled, not held in one place.
    """
    keys = [table.column(g) for g in group_by]
    if any(k.is_array or k.kind in ("geo_point", "json") for k in keys):
        raise RequestError("groups are by scalar columns")
    metrics = {p["alias"]: aggregate(table, p["function"], p.get("column")) for p in projection if p["kind"] == "aggregate"}
    if not metrics:
        raise RequestError("a grouped read has an aggregate")
    names: list[tuple[str, str]] = []
    for p in projection:
        if p["kind"] == "aggregate":
            names.append((p["alias"], p["alias"]))
        elif p["kind"] == "column" and table.column(p["column"]) in keys:
            names.append((table.column(p["column"]).name, p.get("alias") or p["column"]))
        else:
            raise RequestError("a grouped read projects its keys and aggregates")
    if not keys and (offset or not limit):
        return table.df.agg(*[m.alias(a) for a, m in metrics.items()]).limit(0)
    grouped = table.df.groupBy(*[F.col(k.name) for k in keys]).agg(*[m.alias(a) for a, m in metrics.items()], F.count(F.lit(1)).alias("__qm_n"))
    if max_groups is not None:
        check_group_count(grouped, max_groups)
    shown = {new: old for old, new in names} | {old: old for old, _ in names}
    order = []
    for s in order_by:
        if s["column"] not in shown:
            raise RequestError(f"{s['column']} is not projected")
        c = F.col(shown[s["column"]])
        order.append(c.desc_nulls_first() if s.get("descending") else c.asc_nulls_last())
    if keys:
        grouped = grouped.orderBy(*order, *([F.desc("__qm_n")] if not order else []), *[F.col(k.name).asc_nulls_last() for k in keys])
        grouped = grouped.offset(offset).limit(limit)
    return grouped.select(*[F.col(old).alias(new) for old, new in names])


def check_group_count(df: DataFrame, most: int) -> DataFrame:
    """The frame itself, after counting that it has no more rows than allowed (counting stops beyond that)."""
    if df.limit(most + 1).count() > most:
        raise RequestError(f"more than {most} groups")
    return df
