"""Fleets read by one job, and relations of the session's own catalog."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftline.functions.annotations import parse_annotations
from driftline.operators.catalog import column_types, discover_tables, qualify_keys, with_existence
from driftline.sources.fleet import for_all
from driftline.sources.live import relations

ROWS = "id bigint, v string"


def save(spark, path, n):
    spark.range(n).selectExpr("id", "repeat(cast(id as string), 40) as v").coalesce(1).write.parquet(path)


@pytest.mark.parametrize("whole", [False, True])
def test_tables_that_cannot_be_read_do_not_stop_the_fleet(spark, tmp_path, whole):
    for name, n in (("d/s/good", 5), ("d/s/cut", 900), ("d/s/empty", 0), ("d/s/unknown", 7), ("e/s/half", 10), ("e/s/gone", 3)):
        save(spark, f"{tmp_path}/{name}", n)
    save(spark, f"{tmp_path}/e/s/half/more", 4)  # a file at another depth is another table's
    (file,) = (tmp_path / "d/s/cut").glob("*.parquet")
    file.write_bytes(file.read_bytes()[:-200])
    for f in (tmp_path / "e/s/gone").iterdir():
        f.unlink()
    unknown = [("d", "s", "unread", None)]
    save(spark, f"{tmp_path}/d/s/unread", 3)
    (file,) = (tmp_path / "d/s/unread").glob("*.parquet")
    file.write_bytes(b"PAR1")
    inventory = spark.createDataFrame(
        [("d", "s", "good", 5), ("d", "s", "cut", 900), ("d", "s", "empty", 0), ("d", "s", "unknown", None), ("e", "s", "half", 12),
         ("e", "s", "gone", 3), ("e", "s", "never", 1), ("x", "s", "t", 1), *unknown],
        "database string, schema string, tbl string, n bigint",
    )
    roots = {d: f"{tmp_path}/{d}" for d in "dex"}
    made = for_all(spark, roots, inventory, ROWS, lambda rows: rows.groupBy("database", "schema", "tbl").agg(F.sum("id").alias("total")), whole)
    got = {f"{r.database}.{r.tbl}": (r.total, r.status, r.error) for r in made.collect()}
    assert got == {
        "d.good": (10, "ok", None), "d.empty": (None, "ok", None), "d.unknown": (21, "ok", None),
        "d.cut": (None, "failed", "read 0 of 900 rows"), "d.unread": (None, "failed", "nothing could be read"),
        "e.half": (None, "failed", "read 10 of 12 rows"), "e.gone": (None, "failed", "missing"), "e.never": (None, "failed", "missing"),
        "x.t": (None, "failed", "missing"),
    }


def test_damage_within_a_file_is_found_by_reading_it(spark, tmp_path):
    save(spark, f"{tmp_path}/d/s/t", 4_000)
    (file,) = (tmp_path / "d/s/t").glob("*.parquet")
    data = bytearray(file.read_bytes())
    pages = len(data) - 8 - int.from_bytes(data[-8:-4], "little")
    data[4:pages] = b"\xff" * (pages - 4)  # the footer stays
    file.write_bytes(data)
    inventory = spark.createDataFrame([("d", "s", "t", 4_000)], "database string, schema string, tbl string, n bigint")
    count = lambda rows: rows.groupBy("database", "schema", "tbl").agg(F.count("v").alias("rows"))
    assert for_all(spark, {"d": f"{tmp_path}/d"}, inventory, ROWS, count, whole=True).first().status == "failed"


def test_the_session_catalog_equals_a_dump_of_it(spark, tmp_path):
    on = '{"bootstrap":{"enabled":true,"bq":"wh.t"}}'
    try:
        spark.sql(f"create database live_a location '{tmp_path}/a'")
        spark.sql(f"create database live_b location '{tmp_path}/b'")
        spark.sql(f"create table live_a.one (id int, price decimal(12,2), tags array<string>) using parquet comment '{on}' tblproperties ('primary_key'='id')")
        spark.sql("create table live_b.od_d (tenant string, id bigint, s struct<a:int,b:map<string,int>>) using parquet tblproperties ('primary_key'='tenant, id')")
        spark.sql("create table live_b.three (code string, note varchar(9)) using parquet comment 'it''s not json'")
        spark.sql("create view live_b.seen as select 1 as id")
        found = relations(spark, ["live_a", "live_b"])
        tables = discover_tables(found.tables, found.classes, found.namespaces)
        got = {(r.schema, r.tbl): (r.comment, r.annotation and tuple(r.annotation)) for r in parse_annotations(tables).collect()}
        assert got == {("live_a", "one"): (on, (True, "wh", "t")), ("live_b", "od_d"): (None, None), ("live_b", "three"): ("it's not json", None)}
        keys = {r.tbl: (r.reason, r.pk_columns) for r in qualify_keys(tables, found.constraints, found.key_columns, found.columns).collect()}
        assert keys["one"] == ("single", ["id"]) and keys["od_d"] == ("composite", ["tenant", "id"]) and keys["three"][0] not in ("single", "composite")
        types = {r.tbl: r.types for r in column_types(found.columns).collect()}
        assert types["one"] == {"id": "int", "price": "decimal(12,2)", "tags": "array<string>"}
        assert types["od_d"] == {"tenant": "string", "id": "bigint", "s": "struct<a:int,b:map<string,int>>"}
        asked = found.tables.select("database", "schema", "tbl").unionByName(spark.createDataFrame([("spark_catalog", "live_a", "none")], "database string, schema string, tbl string"))
        assert {r.tbl for r in with_existence(asked, found.tables, "there").filter("not there").collect()} == {"none"}
        spark.sql("drop table live_a.one")
        assert relations(spark, ["live_a"]).tables.count() == 0
    finally:
        spark.sql("drop database if exists live_a cascade")
        spark.sql("drop database if exists live_b cascade")
