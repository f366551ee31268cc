"""Facet counts: the direct children of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.plans.filters import Lowering, without_own
from querymill.table import RequestError, Table


def facets(table: Table, column: str, root: str, limit: int = 10, filter_: dict | None = None, exclude_own_filter: bool = False) -> DataFrame:
    """path, doc_count of the children of `root` among matching rows, largest first, then by path."""
    c = table.column(column)
    if c.scalar != "facet" or not root.startswith("/") or not 1 <= limit <= 10_000:
        raise RequestError("facets take a facet column, a root path and a limit of 1 to 10000")
    kept = without_own(filter_, c.name) if exclude_own_filter else filter_
    head = root.rstrip("/") + "/"
    child = lambda p: F.when(F.startswith(p, F.lit(head)), F.concat(F.lit(head), F.get(F.split(F.substr(p, F.lit(len(head) + 1)), "/"), F.lit(0))))
    paths = F.col(c.name) if c.is_array else F.array(c.name)
    found = F.array_distinct(F.filter(F.transform(paths, child), lambda x: x.isNotNull()))
    df = table.df.where(Lowering(table, scored=False).where(kept))
    return df.select(F.explode(found).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("doc_count")).orderBy(F.desc("doc_count"), "path").limit(limit)
