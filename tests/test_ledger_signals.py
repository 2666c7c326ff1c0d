from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.functions.names import ledger_key
from driftline.operators import ledger as led
from driftline.operators import signals as sig

TABLE = "database string, schema string, tbl string"
LEDGER = f"{TABLE}, row_count bigint, captured_at timestamp_ntz, expires_at timestamp_ntz"
T0 = datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture
def ledger(spark):
    counts = spark.createDataFrame(
        [("d", "s", "a", 3), ("d", "s", "b", 0), ("d", "s", "c", 7), ("d", "s2", "a", 5)], f"{TABLE}, row_count bigint"
    )
    return led.ledger_put(spark.createDataFrame([], LEDGER), counts, str(T0), 300)


def test_zero_counts_are_not_kept(ledger):
    assert {(r.schema, r.tbl) for r in ledger.collect()} == {("s", "a"), ("s", "c"), ("s2", "a")}
    assert {r.expires_at for r in ledger.collect()} == {at(300)}


def test_put_replaces_and_no_ttl_means_forever(spark, ledger):
    again = spark.createDataFrame([("d", "s", "a", 4)], f"{TABLE}, row_count bigint")
    after = led.ledger_put(ledger, again, str(at(10)), 0)
    rows = {(r.schema, r.tbl): r for r in after.collect()}
    assert len(rows) == 3
    assert rows["s", "a"].row_count == 4
    assert rows["s", "a"].expires_at is None
    assert {r.tbl for r in led.ledger_live(after, str(at(10_000))).collect()} == {"a"}


def test_entries_live_until_their_expiry(ledger):
    assert led.ledger_live(ledger, str(at(299))).count() == 3
    assert led.ledger_live(ledger, str(at(300))).count() == 0


def test_reconcile_and_settle(spark, ledger):
    target = spark.createDataFrame([("d", "s", "a", 3), ("d", "s", "c", 6)], f"{TABLE}, n bigint")
    result = led.reconcile(ledger, target, str(at(5)))
    assert {(r.schema, r.tbl): r.status for r in result.collect()} == {
        ("s", "a"): "matched",
        ("s", "c"): "pending",
        ("s2", "a"): "target_missing",
    }
    assert {r.status for r in led.reconcile(ledger, target, str(at(301))).collect()} == {"expired"}
    tables = spark.createDataFrame([("d", "s", "a", T0), ("e", "s", "a", T0), ("d", "s", "c", T0)], f"{TABLE}, created_at timestamp_ntz")
    counts, log = led.settle(ledger, sig.signals_for(tables), result)
    assert {(r.schema, r.tbl) for r in counts.collect()} == {("s", "c"), ("s2", "a")}
    # The table of equal name in another database keeps its signal, under the same id.
    assert {(r.database, r.id) for r in log.collect()} == {
        ("e", "snap_s_a_1704110400"),
        ("d", "snap_s_c_1704110400"),
    }


def test_decoded_values(spark):
    df = spark.createDataFrame([("12",), ("no json",), ('{"a":1}',)], "v string")
    got = df.select(F.to_json(F.struct(led.decode_value(F.col("v")).alias("v"))).alias("j"))
    assert [json.loads(r.j)["v"] for r in got.collect()] == [12, "no json", {"a": 1}]


def test_ledger_key(spark):
    row = spark.createDataFrame([("d", "s", "t")], TABLE).select(ledger_key("cache", "row_counts").alias("k")).first()
    assert row.k == "cache:row_counts:table_sync:d.s.t:yugabyte_count"


@pytest.fixture
def log(spark):
    tables = spark.createDataFrame(
        [("d", "s", "a", at(0), "execute-snapshot"), ("d", "s", "a", at(60), "execute-snapshot"),
         ("d", "s", "b", at(120), "schema-change"), ("d", "s", "c", at(180), "pause"),
         ("d", "s", "ab", at(240), "execute-snapshot")],
        f"{TABLE}, created_at timestamp_ntz, kind string",
    )
    return sig.signals_for(tables, F.col("kind"))


def test_ids_and_payloads(log):
    rows = {r.id: (r.type, json.loads(r.data)) for r in log.collect()}
    snapshot = {"data-collections": ["s.a"], "type": "incremental"}
    assert rows == {
        "snap_s_a_1704110400": ("execute-snapshot", snapshot),
        "snap_s_a_1704110460": ("execute-snapshot", snapshot),
        "snap_s_b": ("schema-change", {"database": "d"}),
        "snap_s_c": ("pause", {}),
        "snap_s_ab_1704110640": ("execute-snapshot", {"data-collections": ["s.ab"], "type": "incremental"}),
    }


def test_zone_of_the_session_does_not_matter(spark, log):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert "snap_s_a_1704110400" in {r.id for r in log.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lookup_and_removal_by_collection(spark, log):
    tables = spark.createDataFrame([("d", "s", "a"), ("d", "s", "b"), ("d", "s", "z")], TABLE)
    assert {r.tbl: (r.signals, r.has_signal) for r in sig.has_signal(tables, log).collect()} == {
        "a": (2, True),
        "b": (0, False),
        "z": (0, False),
    }
    assert {r.tbl: r.listed for r in sig.signal_ids(tables, log).collect()} == {"a": False, "b": True, "z": False}
    assert {r.collection for r in sig.collections(log).collect()} == {"s.a", "s.ab"}
    left = sig.remove(log, spark.createDataFrame([("s.a",)], "collection string"))
    assert {r.id for r in left.collect()} == {"snap_s_b", "snap_s_c", "snap_s_ab_1704110640"}


def test_removal_of_one_of_several_collections(spark):
    log = spark.createDataFrame(
        [("1", "execute-snapshot", '{"data-collections":["s.a","s.b"]}', T0), ("2", "x", "no json", T0), ("3", "x", None, T0)],
        "id string, type string, data string, created_at timestamp_ntz",
    )
    left = sig.remove(log, spark.createDataFrame([("s.b",)], "collection string"))
    assert {r.id for r in left.collect()} == {"2", "3"}


def test_retention_order_and_expiry(spark, log):
    assert sig.retain(log, str(at(120) + timedelta(hours=1)), hours=1).count() == 3
    newest = [r.created_at for r in sig.active(log).collect()]
    assert newest == sorted(newest, reverse=True)
    timed = log.withColumn("ttl_seconds", F.when(F.col("type") == "pause", None).otherwise(F.lit(100)))
    assert {r.id for r in sig.expire(timed, str(at(200))).collect()} == {"snap_s_b", "snap_s_c", "snap_s_ab_1704110640"}


def test_append_keeps_ids_unique(log):
    assert sig.append(log, log).count() == log.count()


def test_requests_resolve_to_tables(spark, log):
    catalog = spark.createDataFrame([("d", "s", "a"), ("d", "s", "b"), ("e", "s", "a")], TABLE)
    rows = [tuple(r) for r in sig.snapshot_requests(log, catalog).collect()]
    assert rows == [("d", "s", "a", at(60), 2)]


def test_tables_of_equal_name_in_two_databases(spark, log):
    tables = spark.createDataFrame([("d", "s", "a"), ("e", "s", "a"), ("e", "s", "b")], TABLE)
    assert {(r.database, r.tbl): r.has_signal for r in sig.has_signal(tables, log).collect()} == {("d", "a"): True, ("e", "a"): False, ("e", "b"): False}
    assert not any(r.listed for r in sig.signal_ids(tables, log).filter("listed").collect())
    other = spark.createDataFrame([("e", "s.a")], "database string, collection string")
    assert sig.remove(log, other).count() == log.count()
    assert {(r.database, r.collection) for r in sig.collections(log).collect()} == {("d", "s.a"), ("d", "s.ab")}


def test_append_keeps_the_first_of_an_id(spark, log):
    empty = log.limit(0)
    assert sig.append(empty, log.union(log)).count() == log.count()
    assert sig.append(log, log).count() == log.count()
    later = log.withColumn("created_at", F.col("created_at") + F.expr("interval 1 day"))
    assert sorted(map(tuple, sig.append(empty, later.union(log)).collect())) == sorted(map(tuple, log.collect()))
