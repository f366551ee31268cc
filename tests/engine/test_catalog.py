import json

import pytest

from querymill.operators.catalog import Catalog, Definition
from querymill.sources import backup, ndjson
from querymill.streaming import upserts
from querymill.table import ColumnDef, RequestError

COLUMNS = (
    ColumnDef("id", "integer", False), ColumnDef("title", "text", False, "default"), ColumnDef("price", "real"), ColumnDef("day", "date"), ColumnDef("seen", "date_time"),
    ColumnDef("tags", "text_array", True, "raw"), ColumnDef("body", "json"), ColumnDef("raw", "blob"), ColumnDef("address", "ip"), ColumnDef("big", "unsigned"), ColumnDef("at", "geo_point"),
)
ROW = {"id": 1, "title": "one", "price": 1.5, "day": "2024-01-02", "seen": "2024-01-01T12:00:00+02:00", "tags": ["a", "b"], "body": {"k": 1}, "raw": "0x0aff", "address": "127.0.0.1", "big": 2**64 - 1, "at": {"lat": 1.0, "lon": 2.0}}


@pytest.fixture
def books(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "tables"))
    c.create(Definition("books", COLUMNS, "id", ("volumes",)))
    c.insert("books", [ROW, {"id": 2, "title": "two"}, {"id": 3, "title": "three", "price": 3.0}])
    return c


def rows(c, *columns):
    return sorted(tuple(r) for r in c.table("books").df.select(*(columns or ("id", "title", "price"))).collect())


def equal(column, value):
    return {"kind": "compare", "column": column, "operator": "equal", "value": value}


def test_all_kinds_round_trip(books):
    r = books.table("volumes").df.where("id = 1").first()
    assert str(r["day"]) == "2024-01-02" and r["tags"] == ["a", "b"] and json.loads(r["body"]) == {"k": 1} and bytes(r["raw"]) == b"\x0a\xff"
    assert bytes(r["address"])[-4:] == b"\x7f\0\0\1" and int(r["big"]) == 2**64 - 1 and r["at"]["lon"] == 2.0
    assert books.table("books").df.selectExpr("unix_seconds(seen) AS s").where("s IS NOT NULL").first()[0] == 1704103200


def test_a_batch_is_all_or_nothing(books):
    before = books.generation("books")
    with pytest.raises(RequestError):
        books.insert("books", [{"id": 4, "title": "four"}, {"id": 1, "title": "again"}])
    with pytest.raises(RequestError):
        books.insert("books", [{"id": 5, "title": "five", "nope": 1}])
    with pytest.raises(RequestError):
        books.insert("books", [{"id": 6}])
    assert books.generation("books") == before and len(rows(books)) == 3


def test_limits_and_dry_runs(books):
    f = {"kind": "compare", "column": "id", "operator": "less", "value": 3}
    with pytest.raises(RequestError):
        books.delete("books", f, max_rows=1)
    assert books.delete("books", f, dry_run=True) == 2 and len(rows(books)) == 3
    assert books.delete("books", f) == 2 and [r[0] for r in rows(books)] == [3]


def test_update_and_old_snapshots(books):
    old = books.table("books")
    books.update("books", {"price": 9, "tags": ["z"]}, equal("title", "two"))
    assert rows(books)[1] == (2, "two", 9.0)
    assert old.df.where("id = 2").first()["price"] is None  # an open snapshot stays
    with pytest.raises(RequestError):
        books.update("books", {"id": 7}, equal("id", 1))


def test_optimistic_concurrency(books):
    tag = books.row_tags("books").where("id = 2").first()["etag"]
    books.update_if("books", 2, tag, {"price": 2})
    with pytest.raises(RequestError):
        books.update_if("books", 2, tag, {"price": 3})


def test_deferred_rows_wait_for_flush(books):
    books.upsert("books", [{"id": 2, "title": "TWO"}], deferred=True)
    books.upsert("books", [{"id": 2, "title": "Two!"}], deferred=True)
    assert rows(books)[1][1] == "two"
    again = Catalog(books.spark, books.store.root)  # after a restart
    again.flush("books")
    assert rows(again)[1][1] == "Two!"
    again.flush("books")
    assert len(rows(again)) == 3


def test_schema_changes(books):
    books.change("books", {"kind": "rename_column", "from": "title", "to": "name"})
    books.change("books", {"kind": "add_column", "column": ColumnDef("stock", "integer", False), "default": 4})
    books.change("books", {"kind": "alter_column", "column": "stock", "definition": ColumnDef("stock", "real")})
    books.change("books", {"kind": "drop_column", "column": "day"})
    assert rows(books, "id", "name", "stock")[0] == (1, "one", 4.0)
    for bad in ({"kind": "drop_column", "column": "id"}, {"kind": "add_column", "column": ColumnDef("x", "integer", False)}, {"kind": "rename_column", "from": "price", "to": "NAME"}):
        with pytest.raises(RequestError):
            books.change("books", bad)
    with pytest.raises(Exception):
        books.change("books", {"kind": "alter_column", "column": "name", "definition": ColumnDef("name", "integer")})
    assert rows(books, "name")[0] == ("one",)


def test_names_are_owned_once(books):
    for d in (Definition("BOOKS", COLUMNS, "id"), Definition("other", COLUMNS, "id", ("volumes",)), Definition("third", COLUMNS[1:], "id"), Definition("fourth", (COLUMNS[0], ColumnDef("_score", "real")), "id"), Definition("fifth", (COLUMNS[0], ColumnDef("t", "text")), "id")):
        with pytest.raises(RequestError):
            books.create(d)
    books.add_alias("books", "tomes")
    assert books.definition("Tomes").name == "books"


def test_import(books, tmp_path):
    import gzip

    lines = ['{"id": 2, "title": "first"}', "", '{"id": 9, "title": "nine", "tags": ["q"], "address": "::1"}', '{"id": 2, "title": "last"}']
    path = tmp_path / "in.json.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    assert ndjson.import_file(books, "books", str(path)) == 3
    assert [r[:2] for r in rows(books)] == [(1, "one"), (2, "last"), (3, "three"), (9, "nine")]
    bad = tmp_path / "bad.json"
    bad.write_text('{"id": 20, "title": "x"}\nnot json\n{"id": 21, "title": "y", "what": 1}\n{"title": "no key"}\n')
    before = books.generation("books")
    with pytest.raises(Exception):
        ndjson.import_file(books, "books", str(bad))
    assert books.generation("books") == before
    assert ndjson.import_file(books, "books", str(bad), on_error="skip") == 1


def test_backup_and_restore(books, tmp_path):
    to = str(tmp_path / "backup")
    backup.backup(books, to)
    kept = rows(books)
    books.delete("books", equal("id", 1))
    with pytest.raises(RequestError):
        backup.restore(books, to)
    backup.restore(books, to, force=True)
    assert rows(books) == kept


def test_optimize_and_vacuum(books):
    kept = rows(books)
    books.optimize("books", 2)
    books.vacuum("books")
    assert rows(books) == kept and sum(n.startswith("gen=") for n in books.store.names(books.store.at("books"))) == 1


def test_streamed_upserts_replay_safely(books, tmp_path):
    folder = str(tmp_path / "incoming")
    more = books.spark.createDataFrame([(2, "streamed"), (8, "eight")], "id long, title string")
    typed = books.table("books").df.limit(0).unionByName(more, allowMissingColumns=True)
    typed.write.parquet(folder)
    for _ in range(2):
        upserts.upsert_stream(books, "books", upserts.parquet_stream(books, "books", folder), str(tmp_path / "progress")).awaitTermination()
    assert [r[:2] for r in rows(books)] == [(1, "one"), (2, "streamed"), (3, "three"), (8, "eight")]


def test_cached_aggregations_follow_the_generation(books):
    request = {"n": {"kind": "metric", "function": "count"}}
    first = books.cached_aggregations("books", request)
    assert first["n"]["value"] == 3 and books.cached_aggregations("volumes", request) is first
    books.delete("books", equal("id", 1))
    assert books.cached_aggregations("books", request)["n"]["value"] == 2


def test_command_line(books, tmp_path, monkeypatch, capsys):
    import sys

    from querymill import __main__ as cli

    request = tmp_path / "request.json"
    request.write_text(json.dumps({"projection": [{"kind": "column", "column": "title"}], "order_by": [{"column": "id"}], "limit": 2}))
    monkeypatch.setattr(sys, "argv", ["querymill", books.store.root, "books", "read", str(request)])
    cli.main()
    assert [json.loads(x) for x in capsys.readouterr().out.split("\n") if x] == [{"title": "one"}, {"title": "two"}]
    request.write_text(json.dumps({"aggregations": {"n": {"kind": "metric", "function": "count"}}}))
    monkeypatch.setattr(sys, "argv", ["querymill", books.store.root, "books", "aggregate", str(request)])
    cli.main()
    assert json.loads(capsys.readouterr().out)["n"]["value"] == 3


def test_nested_lines_are_read_flat(spark, tmp_path):
    kept = [
        {"no": 1, "label": "a", "owner": "x", "crew": [{"name": "y", "age": 3}, {"name": None}, {"age": 4}, {"name": 7}], "marks": [3, 1, 3]},
        {"no": 2, "label": None, "crew": [], "marks": [], "more": {"deep": 1}},
    ]
    columns = {"no": ("bigint", "no"), "label": ("string", "label"), "names": ("string", ["owner", "crew[].name"]), "marks": ("bigint", ["marks[]"])}
    path = tmp_path / "nested.json"
    path.write_text("\n".join(map(json.dumps, kept)) + "\n\n")
    got = sorted(map(tuple, ndjson.read_flattened(spark, str(path), columns).collect()))
    assert got == [(1, "a", ["x", "y", "7"], [3, 1, 3]), (2, None, [], [])]
    for bad in ('{"no": 1, "crew": [], "marks": []}', '{"no": 1, "label": "a", "crew": {}, "marks": []}', "[1]", "{"):
        path.write_text(bad)
        with pytest.raises(Exception, match="no label|no array|not an object"):
            ndjson.read_flattened(spark, str(path), columns).collect()
