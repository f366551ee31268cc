"""Small tables made by rules, so that tests can work answers out in plain Python."""

import datetime as dt
import json

from querymill.table import Table

HABITS, PLANTS = ("Climbing", "Dwarf", "Early"), ("beans", "roses", "squashes", "tomatoes")
BEDS = {"beans": "field", "roses": "border", "squashes": "field", "tomatoes": "glass"}
#: sku, name, bed, grams, organic, packed, remark
SEEDS = [
    (10 + k, f"{HABITS[k % 3]} {PLANTS[k // 3]}", BEDS[PLANTS[k // 3]], 1.25 * (k * 7 % 12) + 2, k % 4 == 0, dt.datetime(2025, 3, 1 + k, 6, 30, tzinfo=dt.timezone.utc), ("needs shade", None, "hardy")[k * 5 % 3])
    for k in range(12)
]


def seeds(spark, parts=None):
    df = spark.createDataFrame(SEEDS, "sku long, name string, bed string, grams double, organic boolean, packed timestamp, remark string")
    return Table.of(df.repartition(parts) if parts else df, "sku", "seeds", analyzers={"name": {"stem": "english"}, "bed": "raw"})


#: Buoys along a meridian, one beyond each end of the map, and one by the pole; further positions of each.
BUOYS = [(1, (0.0, 40.0), [(0.0, 40.0), (1.0, 40.0), (0.0, 40.0)]), (2, (1.0, 40.0), [(1.0, 40.0)]), (3, (-30.0, 179.5), [(-30.0, 179.5)]), (4, (-30.0, -179.5), [(-30.0, -179.5)]), (5, (88.0, 10.0), [(88.0, 10.0)]), (6, None, None)]
DEGREE = 6_371_008.8 * 3.141592653589793 / 180


def buoys(spark):
    return Table.of(spark.createDataFrame(BUOYS, "id long, at struct<lat:double,lon:double>, track array<struct<lat:double,lon:double>>"), "id", "buoys")


#: Log lines: some lack a field.
LOGS = [{"level": "warn", "ms": 40, "load": 0.5, "ok": True, "on": "2025-05-01T00:00:00Z"}, {"level": "info", "ms": 7, "load": 1.5, "ok": True, "on": "2025-05-03T00:00:00Z"}, {"ms": 12, "ok": False, "on": "2025-05-05T00:00:00Z"}, {"level": "info", "ms": 99, "ok": False}]


def logs(spark):
    return Table.of(spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(LOGS)], "id long, body string"), "id", "logs", {"body": "json"})


SHELVES = [(k, f"/shop/{'tools' if k % 2 else 'pots'}/{'large' if k % 3 else 'small'}", "in" if k < 5 else "out") for k in range(8)]


def shelves(spark):
    return Table.of(spark.createDataFrame(SHELVES, "id long, place string, stock string"), "id", "shelves", {"place": "facet"}, {"stock": "raw"})


LISTS = [(1, ["x", "y"], [4, 6]), (2, ["y"], [6]), (3, [], []), (4, None, None)]


def lists(spark):
    return Table.of(spark.createDataFrame(LISTS, "id long, marks array<string>, sizes array<long>"), "id", "lists", analyzers={"marks": "raw"})
