"""Registered queries that have no test of their own elsewhere, against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from querymill import queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in queries.SQL if n.startswith(("b0", "b1", "a0", "f05", "f06", "f09", "o05", "p02", "s0", "x0", "m0")))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(got.select(*[f"`{c}`" for c in columns]).collect()) == text(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
