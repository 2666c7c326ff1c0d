"""Discovery on the eight seeded tables, and the rules that single tables show best."""

from __future__ import annotations

import pytest

from driftline.operators import catalog as cat
from driftline.sources import admin_text as adm

SEEDED = [
    ("public", "testtable", '{"bootstrap":{"enabled":true, "bq": "backup.testtable"}}'),
    ("public", "debezium_signal", None),
    ("public", "database_stream", None),
    ("test_schema", "testtable", '{"bootstrap":{"enabled":true, "bq": "test_schema.testtable"}}'),
    ("test_schema", "augmentations", '{"bootstrap":{"enabled":true, "bq": "test_schema.augmentations"}}'),
    ("test_schema", "usage_hints", '{"bootstrap":{"enabled":false, "bq": "test_schema.usage_hints"}}'),
    ("test_schema", "param_hints", None),
    ("test_schema", "examples", '{"bootstrap":{"enabled":true, "bq": "test_schema.examples"}}'),
]
KEY = {"database_stream": "stream_id"}


def rel(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def relations(spark):
    table = "database string, schema string, tbl string"
    names = [("testdb", s, t) for s, t, _ in SEEDED]
    return {
        "tables": rel(spark, [(*n, "BASE TABLE") for n in names], f"{table}, table_type string"),
        "classes": rel(spark, [("testdb", s, t, c) for s, t, c in SEEDED], "database string, namespace_oid string, tbl string, comment string"),
        "namespaces": rel(spark, [("testdb", s, s) for s in ("public", "test_schema")], "database string, namespace_oid string, schema string"),
        "constraints": rel(spark, [(*n, f"{n[2]}_pkey", "PRIMARY KEY") for n in names], f"{table}, constraint_name string, constraint_type string"),
        "key_columns": rel(spark, [(*n, f"{n[2]}_pkey", KEY.get(n[2], "id"), 1) for n in names], f"{table}, constraint_name string, column_name string, ordinal_position int"),
        "columns": rel(spark, [(*n, KEY.get(n[2], "id")) for n in names], f"{table}, column_name string"),
        "listing": rel(spark, [(*n, f"{n[1]}.{n[2]}") for n in names], f"{table}, table_id string"),
        "stream_tables": rel(spark, [("s1", f"{n[1]}.{n[2]}") for n in names if n[2] != "examples"], "stream_id string, table_id string"),
        "streams": rel(spark, [("testdb", "s1", 1)], "database string, stream_id string, created_at int"),
    }


def test_seeded_tables(relations):
    found = cat.discover_candidates(**relations)
    assert [(r.schema, r.tbl, r.reason) for r in found.orderBy("schema", "tbl").collect()] == [
        ("public", "testtable", "single"),
        ("test_schema", "augmentations", "single"),
        ("test_schema", "param_hints", "single"),
        ("test_schema", "testtable", "single"),
        ("test_schema", "usage_hints", "single"),
    ]
    assert {(r.schema, r.tbl) for r in cat.enabled(found).collect()} == {
        ("public", "testtable"),
        ("test_schema", "testtable"),
        ("test_schema", "augmentations"),
    }
    assert {r.tbl for r in cat.not_enabled(found).collect()} == {"param_hints", "usage_hints"}


def test_no_stream_no_tables(relations):
    found = cat.discover_candidates(**{**relations, "streams": relations["streams"].limit(0)})
    assert found.count() == 0


def test_discovery_is_ordered_and_can_be_restricted(relations):
    args = (relations["tables"], relations["classes"], relations["namespaces"])
    rows = [(r.schema, r.tbl) for r in cat.discover_tables(*args).collect()]
    assert rows == sorted(rows)
    assert len(rows) == 7
    assert cat.discover_tables(*args, database="other").count() == 0


def test_exclusions_are_exact_names(spark):
    databases = spark.createDataFrame(
        [("sys", False), ("system_platform", False), ("app", False), ("template1", True)],
        "datname string, datistemplate boolean",
    )
    left = lambda ex: {r.datname for r in cat.discover_databases(databases, ex).collect()}
    assert left("postgres, system_platform") == {"sys", "app"}
    assert left(["sys"]) == {"system_platform", "app"}
    assert left(databases.filter("datname = 'app'")) == {"sys", "system_platform"}
    assert left("") == {"sys", "system_platform", "app"}


def test_key_reasons(spark):
    t = "database string, schema string, tbl string"
    tables = spark.createDataFrame([("d", "s", x) for x in ("one", "two", "code", "none", "noid", "uniq")], t)
    constraints = [("one", "PRIMARY KEY"), ("two", "PRIMARY KEY"), ("code", "PRIMARY KEY"), ("noid", "PRIMARY KEY"),
                   ("uniq", "UNIQUE")]
    keys = [("one", "id", 1), ("two", "id", 2), ("two", "tenant", 1), ("code", "code", 1), ("noid", "code", 1), ("uniq", "id", 1)]
    found = cat.qualify_keys(
        tables,
        spark.createDataFrame([("d", "s", x, "k", c) for x, c in constraints], f"{t}, constraint_name string, constraint_type string"),
        spark.createDataFrame([("d", "s", x, "k", c, i) for x, c, i in keys], f"{t}, constraint_name string, column_name string, ordinal_position int"),
        spark.createDataFrame([("d", "s", x, "id") for x in ("one", "two", "code", "none", "uniq")], f"{t}, column_name string"),
    )
    assert {r.tbl: (r.qualifies, r.reason, r.pk_columns) for r in found.collect()} == {
        "one": (True, "single", ["id"]),
        "two": (True, "composite", ["tenant", "id"]),
        "code": (False, "id_not_in_key", ["code"]),
        "none": (False, "no_primary_key", None),
        "noid": (False, "no_id_column", ["code"]),
        "uniq": (False, "no_primary_key", None),
    }


def test_ambiguous_id_is_no_id(spark):
    t = "database string, schema string, tbl string"
    tables = spark.createDataFrame([("d", "s", "a"), ("d", "s", "b"), ("d", "s", "c")], t)
    listing = spark.createDataFrame([("d", "s", "a", "1"), ("d", "s", "b", "2"), ("d", "s", "b", "3")], f"{t}, table_id string")
    assert [(r.tbl, r.table_id) for r in cat.resolve_table_ids(tables, listing).collect()] == [("a", "1")]


def test_first_stream_and_put_if_absent(spark):
    schema = "database string, stream_id string, created_at int"
    registry = spark.createDataFrame([("a", "a2", 2), ("a", "a1", 1), ("b", "bz", 5), ("b", "ba", 5)], schema)
    assert {r.database: r.stream_id for r in cat.lookup_stream(registry).collect()} == {"a": "a1", "b": "ba"}
    new = spark.createDataFrame([("a", "a0", 0), ("c", "c2", 2), ("c", "c1", 1)], schema)
    assert cat.register_streams(registry, new).count() == 5
    assert {r.database: r.stream_id for r in cat.lookup_stream(cat.register_streams(registry, new)).collect()}["c"] == "c1"


def test_admin_text(spark):
    uuid = "0000400000003000800000000000400a"
    lines = [
        "",
        f"ysql.testdb.orders [ysql_schema=public] [{uuid}] [tbl]",
        f"\t ysql.testdb.a.b  [ysql_schema=s]   [{uuid}]  [x] [y] ",
        f"ysql.testdb.short [ysql_schema=public] [{uuid}]",
        f"ycql.testdb.orders [ysql_schema=public] [{uuid}] [tbl]",
        f"ysql.testdb.orders [other=public] [{uuid}] [tbl]",
    ]
    listing = adm.parse_table_listing(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(tuple(r) for r in listing.collect()) == [
        ("testdb", "public", "orders", uuid),
        ("testdb", "s", "a.b", uuid),
    ]
    info = ["CDC Stream Info:", f'  table_id: "{uuid}"', f'    table_id:"{uuid}"', f'x table_id: "{uuid}"', 'table_id: "zz"']
    found = adm.parse_stream_info(spark.createDataFrame([("s", x) for x in info], "stream_id string, value string"))
    assert [tuple(r) for r in found.collect()] == [("s", uuid)]
    created = spark.createDataFrame([(f"cdc stream id: {uuid}",), ("none",)], "value string")
    assert [r.stream_id for r in adm.parse_stream_id(created).collect()] == [uuid]


def test_types_per_table(spark):
    columns = spark.createDataFrame(
        [("d", "s", "t", "id", "integer"), ("d", "s", "t", "doc", "jsonb"), ("d", "s", "u", "id", "uuid")],
        "database string, schema string, tbl string, column_name string, data_type string",
    )
    assert {r.tbl: r.types for r in cat.column_types(columns).collect()} == {
        "t": {"id": "integer", "doc": "jsonb"},
        "u": {"id": "uuid"},
    }
