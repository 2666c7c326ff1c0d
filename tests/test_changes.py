from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import changes as ch

LOG = "id bigint, op string, lsn bigint, v string"


def brute(state, changes):
    """One record at a time: the highest lsn of a key wins."""
    best = {r[0]: r for r in state}
    for r in changes:
        if r[0] not in best or r[2] >= best[r[0]][2]:
            best[r[0]] = r
    return sorted(best.values(), key=repr)


def random_log(lsns, keys, seed):
    rng = random.Random(seed)
    rng.shuffle(lsns)
    rows = []
    for lsn in lsns:
        op = rng.choice("cuud")
        key = 0 if rng.random() < 0.4 else rng.randrange(keys)
        rows.append((key, op, lsn, None if op == "d" else f"v{lsn}"))
    return rows


@pytest.mark.parametrize(("broadcast", "few"), [("10485760", False), ("-1", False), ("-1", True)])
@pytest.mark.parametrize("seed", [1, 2])
def test_apply_equals_one_by_one(spark, seed, broadcast, few):
    # Odd places are the state's, even ones arrive later: half of them are too late.
    old = brute([], random_log(list(range(1, 600, 2)), 60, seed))
    new = random_log(list(range(0, 600, 2)), 90, seed + 10)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, broadcast)
    try:
        state, changes = spark.createDataFrame(old, LOG), spark.createDataFrame(new, LOG)
        got = ch.apply_changes(state, changes, ["id"], ["lsn"], few)
        rows = sorted((tuple(r) for r in got.collect()), key=repr)
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert rows == brute(old, new)


def test_apply_composite_key_and_order(spark):
    schema = "a int, b string, op string, lsn bigint, seq int, v int"
    state = spark.createDataFrame([(1, "x", "r", 5, 1, 10), (1, "y", "r", 5, 1, 11)], schema)
    changes = spark.createDataFrame(
        [(1, "x", "u", 5, 2, 20), (1, "x", "u", 5, 3, 30), (1, "y", "u", 4, 9, 40), (2, "x", "c", 1, 1, 50)], schema
    )
    got = ch.apply_changes(state, changes, ["a", "b"], ["lsn", "seq"])
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "x", "u", 5, 3, 30),
        (1, "y", "r", 5, 1, 11),
        (2, "x", "c", 1, 1, 50),
    ]


def test_state_is_not_shuffled_by_small_changes(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "'r' as op", "-1L as lsn", "repeat('x', 50) as v").write.parquet(f"{tmp_path}/s")
    state = spark.read.parquet(f"{tmp_path}/s")
    changes = spark.createDataFrame([(3, "d", 1, None)], LOG)
    applied = ch.apply_changes(state, changes, ["id"], ["lsn"], few=True)
    assert applied.count() == 200_000
    plan = applied._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert "ShuffledHashJoin" not in plan


def test_a_missing_place_counts_as_oldest(spark):
    state = spark.createDataFrame([(1, "r", None, "s"), (2, "r", 3, "s")], LOG)
    changes = spark.createDataFrame([(1, "u", None, "c"), (2, "u", None, "c")], LOG)
    got = ch.apply_changes(state, changes, ["id"], ["lsn"])
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "c"), (2, "s")]


def test_latest_of_hot_key_is_reduced_before_the_shuffle(spark):
    log = spark.range(0, 50_000, 1, 8).selectExpr("0L as id", "'u' as op", "id as lsn", "cast(id as string) as v")
    latest = ch.latest_per_key(log, ["id"], ["lsn"])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
    assert [tuple(r) for r in latest.collect()] == [(0, "u", 49_999, "49999")]


def test_latest_with_maps_and_ties(spark):
    rows = [(1, "u", 1, {"a": 1}), (1, "u", 2, {"a": 2}), (2, "c", 1, None)]
    log = spark.createDataFrame(rows, "id int, op string, lsn int, m map<string,int>")
    assert sorted((r.id, r.m) for r in ch.latest_per_key(log, ["id"], ["lsn"]).collect()) == [(1, {"a": 2}), (2, None)]
    tied = spark.createDataFrame([(1, "u", 1, "x"), (1, "u", 1, "y")], LOG)
    for parts in (1, 2, 3):
        assert ch.latest_per_key(tied.repartition(parts), ["id"], ["lsn"]).first().v == "y"


def test_unwrap_keeps_deletes_without_image(spark):
    rows = spark.createDataFrame(
        [((1,), "c", 1, ("a", 1)), ((2,), "d", 2, None), ((3,), "d", 3, ("old", 7))],
        "key struct<id:int>, op string, lsn bigint, after struct<name:string,id:int>",
    )
    got = ch.unwrap(rows, meta=("op", "lsn"))
    assert got.columns == ["id", "op", "lsn", "name"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "c", 1, "a"), (2, "d", 2, None), (3, "d", 3, None)]


def test_messages_become_envelopes(spark):
    from driftline.sources.changes import envelopes, json_of

    messages = spark.createDataFrame(
        [(b'{"id":1}', b'{"id":1,"v":"a"}', 7), (b'{"id":1}', None, 8), (b'{"id":2}', b'{"v":null}', 9)],
        "key binary, value binary, offset bigint",
    ).withColumn("timestamp", F.lit(0).cast("timestamp"))
    log = ch.unwrap(envelopes(messages, json_of("id bigint"), json_of("id bigint, v string")))
    assert [(r.id, r.op, r.lsn, r.v) for r in log.orderBy("lsn").collect()] == [
        (1, "u", 7, "a"),
        (1, "d", 8, None),
        (2, "u", 9, None),
    ]


def test_exclude_matches_the_full_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, id2 int, other int")
    assert ch.exclude_columns(df, ["s.t.id"], "s.t").columns == ["id2", "other"]
    assert ch.exclude_columns(df, ["s.other_table.id"], "s.t").columns == df.columns
    assert ch.exclude_columns(df, [r"s\.t\.id.*"], "s.t").columns == ["other"]


def test_key_round_trip(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    nested = ch.nest_key(df, ["id"])
    assert nested.schema["id"].dataType.simpleString() == "struct<id:int>"
    assert ch.flatten_key(nested).collect() == df.collect()
    assert ch.flatten_key(df).collect() == df.collect()
    other = ch.nest_key(df, ["v"])
    assert ch.flatten_key(other).schema == other.schema


def test_normalise(spark):
    df = spark.createDataFrame(
        [((5,), (1, None), {"k": 2}, [1, 2], "t")],
        "id struct<id:int>, doc struct<a:int,b:string>, m map<string,int>, l array<int>, s string",
    )
    types = {"doc": "jsonb", "m": "text"}
    assert ch.normalise(df, types).first().asDict() == {
        "id": 5,
        "doc": '{"a":1,"b":null}',
        "m": '{"k":2}',
        "l": [1, 2],
        "s": "t",
    }
    assert ch.unexpected_records(df, types) == ["m"]


def test_handoff_prefers_any_streamed_change(spark):
    from driftline.operators.snapshot import handoff

    snapshot = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "id bigint, v string")
    changes = spark.createDataFrame([(2, "u", 0, "c2"), (3, "d", 0, None), (4, "c", 1, "c4"), (5, "d", 2, None)], LOG)
    got = handoff(snapshot, changes, ["id"]).orderBy("id")
    assert [(r.id, r.op, r.v) for r in got.collect()] == [(1, "r", "s1"), (2, "u", "c2"), (4, "c", "c4")]
    assert handoff(snapshot, changes, ["id"], tombstones=True).filter(F.col("op") == "d").count() == 2


def test_null_key_parts_are_equal(spark):
    schema = "a int, b int, op string, lsn bigint, v string"
    state = spark.createDataFrame([(1, None, "r", -1, "old"), (1, 2, "r", 9, "new")], schema)
    changes = spark.createDataFrame([(1, None, "u", 3, "x"), (1, 2, "u", 3, "late"), (None, None, "c", 4, "y")], schema)
    for few in (False, True):
        got = ch.apply_changes(state, changes, ["a", "b"], ["lsn"], few).collect()
        assert sorted((r.lsn, r.v) for r in got) == [(3, "x"), (4, "y"), (9, "new")]


def _plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_a_bucketed_state_is_read_once_and_not_moved(spark, tmp_path):
    from driftline.sources.tables import save_bucketed

    old = brute([], random_log(list(range(1, 400, 2)), 60, 3))
    new = random_log(list(range(0, 400, 2)), 90, 4)
    for name, table_keys in (("state_by_id", ["id"]), ("state_by_both", ["id", "part"])):
        state = spark.createDataFrame(old, LOG).withColumn("part", F.col("id") % 3)
        changes = spark.createDataFrame(new, LOG).withColumn("part", F.col("id") % 3)
        changes.write.parquet(f"{tmp_path}/{name}-changes")
        changes = spark.read.parquet(f"{tmp_path}/{name}-changes")
        state = save_bucketed(state, name, f"{tmp_path}/{name}", table_keys, 4)
        try:
            limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
            for k in limits:
                spark.conf.set(k, "-1")
            applied = ch.apply_changes(state, changes, table_keys, ["lsn"], whole_keys=True)
            assert sorted((tuple(r)[:4] for r in applied.collect()), key=repr) == brute(old, new)
            plan = _plan_of(applied)
        finally:
            for k in limits:
                spark.conf.unset(k)
            spark.sql(f"drop table {name}")
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert len(scans) == 2 and sum("Bucketed: true" in line for line in scans) == 1
        # all exchanges lie over the changes: the side of the state goes from its scan to the join by itself
        state_side = plan[plan.index("Join") : plan.index(next(line for line in scans if "Bucketed: true" in line))]
        assert "Exchange" not in state_side


def test_apply_reads_each_side_once(spark, tmp_path):
    for name in ("s", "c"):
        spark.range(1_000).selectExpr("id", "'u' as op", "id as lsn", "'v' as v").write.parquet(f"{tmp_path}/{name}")
    state, changes = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("s", "c"))
    applied = ch.apply_changes(state, changes, ["id"], ["lsn"])
    assert applied.count() == 1_000
    assert sum("FileScan" in line for line in _plan_of(applied).splitlines()) == 2


def test_handoff_is_one_anti_join(spark, tmp_path):
    from driftline.operators.snapshot import handoff

    spark.range(100).selectExpr("id", "'s' as v").write.parquet(f"{tmp_path}/s")
    spark.range(50, 120).selectExpr("id", "if(id % 7 = 0, 'd', 'u') as op", "id as lsn", "'c' as v").write.parquet(f"{tmp_path}/c")
    handed = handoff(spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/c"), ["id"])
    got = {r.id: r.v for r in handed.collect()}
    assert got == {i: "s" if i < 50 else "c" for i in range(120) if i < 50 or i % 7}
    plan = _plan_of(handed)
    assert sum("Join" in line for line in plan.splitlines()) == 1 and "LeftAnti" in plan
    assert sum("FileScan" in line for line in plan.splitlines()) == 3  # the snapshot, the changes, and the keys of the changes
