"""The keyed target: streams against batch, replays, late changes, schema drift."""

from __future__ import annotations

import itertools
import json
import random
import shutil
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.operators.changes import drop_deleted, latest_per_key
from driftline.sources.changes import read_changes
from driftline.streaming.apply import expand_json, load_snapshot, stream_apply, tolerate
from driftline.streaming.batch import append, current, current_version, replace_all
from driftline.streaming.expiry import ORDER, expirations, stream_expirations
from driftline.streaming.quarantine import quarantine, write_quarantined
from driftline.streaming.target import KeyedTarget

LOG = "id bigint, op string, lsn bigint, v string"


def log_rows(n, keys, seed):
    rng = random.Random(seed)
    rows = []
    for lsn in range(n):
        op = rng.choice("cuud")
        key = 0 if rng.random() < 1 / 3 else rng.randrange(keys)
        rows.append((key, op, lsn, None if op == "d" else f"v{lsn}"))
    rng.shuffle(rows)
    return rows


def final(rows):
    best = {}
    for r in rows:
        if r[0] not in best or r[2] > best[r[0]][2]:
            best[r[0]] = r
    return sorted(r for r in best.values() if r[1] != "d")


def table(target, spark):
    return sorted(tuple(r) for r in target.read(spark).select("id", "op", "lsn", "v").collect())


def land(spark, rows, path, files):
    """A landing folder whose files hold the rows in the given order."""
    for i in range(files):
        part = rows[i::files]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("merge_records", [0, 150, 10**9])
def test_stream_equals_batch(spark, tmp_path, merge_records):
    rows = log_rows(400, 40, 7)
    land(spark, rows, f"{tmp_path}/in", 5)
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=4)
    stream = read_changes(spark, f"{tmp_path}/in", LOG, max_files=1)
    query = stream_apply(stream, target, every=None, merge_records=merge_records)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 4
    batch = drop_deleted(latest_per_key(spark.read.parquet(f"{tmp_path}/in"), ["id"], ["lsn"]))
    assert table(target, spark) == sorted(tuple(r) for r in batch.collect()) == final(rows)
    if merge_records:
        assert target.status(spark).records > 0


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    rows = log_rows(300, 30, 3)
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=4)
    for part in (rows[:100], rows[100:250], rows[250:]):
        land(spark, part, f"{tmp_path}/in", 2)
        stream_apply(read_changes(spark, f"{tmp_path}/in", LOG), target, every=None).awaitTermination()
    assert table(target, spark) == final(rows)


def test_table_with_a_column_named_like_the_layout(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=3)
    rows = "id bigint, op string, lsn bigint, bucket string, version int"
    target.buffer(spark.createDataFrame([(1, "c", 1, "b1", 1), (2, "c", 1, "b2", 1)], rows), 0)
    target.merge(spark)
    target.buffer(spark.createDataFrame([(2, "u", 2, "b3", 2)], rows), 1)
    target.merge(spark)
    assert sorted((r.id, r.bucket, r.version) for r in target.read(spark).collect()) == [(1, "b1", 1), (2, "b3", 2)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_wide_keys_are_not_broadcast(spark, tmp_path, monkeypatch, limit):
    from driftline.streaming import target as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
    rows = log_rows(150, 20, 9)
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=3)
    target.buffer(spark.createDataFrame(rows[:80], LOG), 0)
    target.merge(spark)
    status = target.buffer(spark.createDataFrame(rows[80:], LOG), 1)
    last = {r[0]: r[2] for r in sorted(rows[80:], key=lambda r: r[2])}
    assert status.pending[0].key_bytes == sum(len(str(k)) + len(str(lsn)) for k, lsn in last.items())
    assert module._few(status.pending) == (limit > 0)
    assert table(target, spark) == final(rows)
    target.merge(spark)
    assert table(target, spark) == final(rows)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = log_rows(200, 20, 5)
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=3)
    first, second = (spark.createDataFrame(r, LOG) for r in (rows[:120], rows[120:]))
    target.buffer(first, 0)
    target.buffer(first, 0)
    target.merge(spark)
    target.buffer(first, 0)
    target.buffer(second, 1)
    target.buffer(second, 1)
    assert table(target, spark) == final(rows)
    target.merge(spark)
    target.merge(spark)
    assert table(target, spark) == final(rows)


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    from driftline.streaming import target as module

    rows = log_rows(200, 20, 6)
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=3)
    target.buffer(spark.createDataFrame(rows[:100], LOG), 0)
    target.merge(spark)

    def crash(*args, **kwargs):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(module, "commit", crash)
        with pytest.raises(OSError):
            target.buffer(spark.createDataFrame(rows[100:150], LOG), 1)
    assert table(target, spark) == final(rows[:100])
    target.buffer(spark.createDataFrame(rows[100:], LOG), 1)
    with monkeypatch.context() as m:
        m.setattr(module, "commit", crash)
        with pytest.raises(OSError):
            target.merge(spark)
    assert table(target, spark) == final(rows)
    target.merge(spark)
    assert table(target, spark) == final(rows)


def test_late_change_does_not_revive_a_deleted_key(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2)
    target.buffer(spark.createDataFrame([(1, "d", 9, None), (2, "c", 1, "b")], LOG), 0)
    target.merge(spark)
    target.buffer(spark.createDataFrame([(1, "u", 5, "late"), (2, "u", 2, "b2")], LOG), 1)
    assert table(target, spark) == [(2, "u", 2, "b2")]
    target.merge(spark)
    assert table(target, spark) == [(2, "u", 2, "b2")]
    assert target.records(spark).count() == 2


def test_tombstones_go_when_told(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=1)
    target.buffer(spark.createDataFrame([(1, "d", 3, None), (2, "d", 9, None), (3, "c", 1, "c")], LOG), 0)
    target.merge(spark, forget_below=F.col("lsn") < 5)
    assert {r.id for r in target.records(spark).collect()} == {2, 3}
    target.buffer(spark.createDataFrame([(3, "d", 12, None)], LOG), 1)
    target.buffer(spark.createDataFrame([(2, "d", 13, None)], LOG), 2)
    target.merge(spark, forget_below=F.col("lsn") < 20)
    assert target.records(spark).count() == 0
    assert target.read(spark).columns == ["id", "op", "lsn", "v"]
    target.buffer(spark.createDataFrame([(2, "d", 13, None)], LOG), 2)
    assert target.status(spark).records == 0


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=8)
    target.buffer(spark.range(200).selectExpr("id", "'c' as op", "0L as lsn", "'v' as v"), 0)
    target.merge(spark)
    target.buffer(spark.createDataFrame([(3, "u", 1, "new")], LOG), 1)
    target.merge(spark)
    versions = [data for data, _ in target._manifest(spark).buckets.values()]
    assert sorted(v.partition("-")[0] for v in versions) == ["1"] * 7 + ["2"] and len(set(versions)) == 2
    assert target.read(spark).count() == 200
    stale = [r.path for r in target.obsolete(spark).collect()]
    assert len([p for p in stale if "/base/" in p]) == 1
    assert len([p for p in stale if "/delta/" in p]) == 2
    for path in stale:
        shutil.rmtree(path)
    assert target.read(spark).count() == 200
    target.buffer(spark.createDataFrame([(4, "d", 2, None)], LOG), 1)
    target.buffer(spark.createDataFrame([(4, "d", 2, None)], LOG), 2)
    target.merge(spark)
    assert target.read(spark).count() == 199


def test_compaction_leaves_one_file_per_bucket(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2)
    rows = log_rows(300, 50, 11)
    for i in range(4):
        target.buffer(spark.createDataFrame(rows[i * 75 : (i + 1) * 75], LOG), i)
        target.merge(spark, compact=i == 3)
    assert table(target, spark) == final(rows)
    manifest = target._manifest(spark)
    for bucket, (data, _) in manifest.buckets.items():
        files = list((tmp_path / "t" / "base" / f"version={data}" / f"_bucket={bucket}").glob("*.parquet"))
        assert len(files) == 1


def test_schema_drifts_between_batches(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=4)
    target.buffer(spark.createDataFrame([(1, "c", 1, 10), (2, "c", 2, 20)], "id int, op string, lsn bigint, v int"), 0)
    target.merge(spark)
    target.buffer(
        spark.createDataFrame([(2, "u", 3, 2**40, "n")], "id bigint, op string, lsn bigint, v bigint, note string"), 1
    )
    assert target.read(spark).schema["v"].dataType.simpleString() == "bigint"
    target.buffer(spark.createDataFrame([(3, "c", 4, "text")], "id bigint, op string, lsn bigint, v string"), 2)
    want = [(1, "10", None), (2, str(2**40), "n"), (3, "text", None)]
    rows = lambda: sorted(tuple(r) for r in target.read(spark).select("id", "v", "note").collect())
    assert rows() == want
    target.merge(spark)
    assert rows() == want
    assert all(f.nullable for f in target.read(spark).schema.fields)


def test_json_images_evolve_within_a_stream(spark, tmp_path):
    images = [{"a": 1}, {"a": 2, "b": "x"}, {"a": "three"}, {"b": None, "c": [1, 2], "d": {"VOID": None}}]
    for i, image in enumerate(images):
        spark.createDataFrame([(i, "c", i, json.dumps(image))], "id bigint, op string, lsn bigint, after string").coalesce(
            1
        ).write.mode("append").parquet(f"{tmp_path}/in")
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2)
    stream = read_changes(spark, f"{tmp_path}/in", "id bigint, op string, lsn bigint, after string", max_files=1)
    stream_apply(stream, target, every=None, prepare=expand_json).awaitTermination()
    got = {r.id: (r.a, r.b) for r in target.read(spark).collect()}
    assert got == {0: ("1", None), 1: ("2", "x"), 2: ("three", None), 3: (None, None)}
    last = target.read(spark).filter("id = 3").first()
    assert last.c == [1, 2]
    assert "d" not in last.asDict()


def test_bad_records_do_not_stop_a_stream(spark, tmp_path):
    from pyspark.sql import types as T

    lines = ['{"id":1,"op":"c","lsn":1,"v":"a"}', "{broken", '{"id":1,"op":"u","lsn":3,"v":"b"}', '{"id":"x","op":"c","lsn":9}']
    for line in lines:
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2)
    stream = read_changes(spark, f"{tmp_path}/in", "value string", format="text", max_files=1)
    prepare = tolerate(T.StructType.fromDDL(LOG), f"{tmp_path}/records")
    stream_apply(stream, target, every=None, prepare=prepare).awaitTermination()
    assert table(target, spark) == [(1, "u", 3, "b")]
    bad = spark.read.parquet(f"{tmp_path}/records").filter("side = 'bad'")
    assert sorted(r._corrupt for r in bad.collect()) == sorted([lines[1], lines[3]])


def test_deletes_only_batch_creates_the_target(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=16)
    with pytest.raises(ValueError, match="nothing committed"):
        target.read(spark)
    target.buffer(spark.createDataFrame([(1, "d", 1, None)], LOG), 0)
    target.merge(spark)
    assert target.read(spark).count() == 0


def test_empty_batch(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=16)
    target.buffer(spark.createDataFrame([], LOG), 0)
    assert target.read(spark).count() == 0
    target.merge(spark)
    target.buffer(spark.createDataFrame([(1, "c", 1, "a")], LOG), 1)
    target.merge(spark)
    assert table(target, spark) == [(1, "c", 1, "a")]


def test_replace_all(spark, tmp_path):
    path = f"{tmp_path}/r"
    assert current_version(spark, path) is None
    replace_all(spark.range(5), path)
    with pytest.raises(ValueError, match="nothing"):
        replace_all(spark.range(0), path)
    assert current(spark, path).count() == 5
    replace_all(current(spark, path).filter("id > 2"), path)
    assert sorted(r.id for r in current(spark, path).collect()) == [3, 4]
    replace_all(spark.range(0), path, allow_empty=True)
    assert current(spark, path).count() == 0


def test_append_matches_by_name(spark, tmp_path):
    path = f"{tmp_path}/a"
    append(spark.createDataFrame([(1, "x")], "a int, b string"), path, ["a", "b"])
    append(spark.createDataFrame([("y", 2.0, 2)], "b string, extra double, a int"), path, ["a", "b"])
    append(spark.createDataFrame([], "a int, b string"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "y")]


def test_entries_expire_as_the_stream_moves_on(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    batches = [
        [("a", at(0), 60), ("b", at(0), None), ("c", at(0), 0), ("d", at(0), 900)],
        [("a", at(50), 60), ("e", at(700), 60)],
        [("d", at(850), 900), ("z", at(1_500), 60)],
        [("z2", at(9_000), 60), ("kept", at(10), 100), ("short", at(0), 100)],
        [("late", at(100), 10), ("kept", at(60), 0), ("short", at(10), 5), ("end", at(8_000), 1_000), ("end", at(9_000), None)],
    ]
    schema = "k string, at timestamp_ntz, ttl int"
    seen = []
    target = KeyedTarget(f"{tmp_path}/entries", ["k"], ORDER, buckets=2)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        puts = read_changes(spark, f"{tmp_path}/in", schema)
        stream_expirations(puts, target, f"{tmp_path}/out", "at", F.col("ttl"), merge_batches=3).awaitTermination()
        rows = expirations(spark, f"{tmp_path}/out", ["k"]).collect()
        seen.append(sorted((r.k, int((r.lsn / 1e6) - start.replace(tzinfo=UTC).timestamp())) for r in rows))
    # The newest put is the clock.
    assert seen[0] == []
    assert seen[1] == [("a", 110)]
    assert seen[2] == [("a", 110), ("e", 760)]
    third = [("a", 110), ("d", 1_750), ("e", 760), ("kept", 110), ("short", 100), ("z", 1_560)]
    assert seen[3] == third
    # What comes late has its delete at once; a shorter life replaces a longer one, and none an end: the deletes
    # that had been written for them are taken back.
    kept = [r for r in third if r not in (("kept", 110), ("short", 100))]
    assert seen[4] == sorted([*kept, ("late", 110), ("short", 15)])
    assert {r.k for r in target.read(spark).collect()} == {"b", "c", "z2", "end", "kept"}


def test_keys_of_a_group_share_their_state_and_one_timer(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "k string, n bigint, at timestamp_ntz, ttl int"
    target = KeyedTarget(f"{tmp_path}/entries", ["k", "n"], ORDER, buckets=2)
    first = [(f"k{i % 7}" if i % 7 else None, i, at(i + 50 * t), 20) for i in range(60) for t in range(3)]
    for rows in (first, [("clock", 0, at(1_000), None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        puts = read_changes(spark, f"{tmp_path}/in", schema)
        query = stream_expirations(puts, target, f"{tmp_path}/out", "at", F.col("ttl"), groups=5)
        query.awaitTermination()
        stateful = [s for p in query.recentProgress for s in p.stateOperators]
        assert max(s.numRowsTotal for s in stateful) <= 5 and max(s.customMetrics["numRegisteredTimers"] for s in stateful) <= 5
    micros = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp()) * 1_000_000
    got = sorted((r.k or "", r.n, (r.lsn - micros) // 1_000_000) for r in expirations(spark, f"{tmp_path}/out", ["k", "n"]).collect())
    assert got == sorted((k or "", n, int((t - at(0)).total_seconds()) + 20) for k, n, t, _ in first)
    assert [(r.k, r.n) for r in target.read(spark).collect()] == [("clock", 0)]


def expired(puts, clock):
    """By the definition: ends before the next put of the key, up to the clock; and the entries that live on."""
    puts = sorted({s: e for s, e in sorted(puts, key=lambda p: (p[0], p[1] is not None, p[1] or 0))}.items())
    gone = [e for i, (_, e) in enumerate(puts) if e is not None and e <= clock and (i + 1 == len(puts) or e < puts[i + 1][0])]
    last = puts[-1][1]
    return gone, last is None or last > clock


@pytest.mark.parametrize("late", [None, 40])
def test_every_order_of_arrival_leaves_the_same_entries(spark, tmp_path, late):
    """Each key brings the same puts in another order, one in each micro-batch; some have two, at the same time or so."""
    puts = [(0, 100), (30, None), (50, 10), (60, 45), (60, None)]
    start = datetime(2024, 1, 1)
    orders = list(itertools.permutations(puts))
    batches = [[(f"k{i}", start + timedelta(seconds=o[n][0]), o[n][1]) for i, o in enumerate(orders)] for n in range(len(puts))]
    batches.append([("clock", start + timedelta(seconds=200), None)])
    schema = "k string, at timestamp_ntz, ttl int"
    target = KeyedTarget(f"{tmp_path}/entries", ["k"], ORDER, buckets=2)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n % 2:
            stream = read_changes(spark, f"{tmp_path}/in", schema, max_files=1)
            stream_expirations(stream, target, f"{tmp_path}/out", "at", F.col("ttl"), late=late).awaitTermination()
    micros = int(start.replace(tzinfo=UTC).timestamp()) * 1_000_000
    gone, lives = expired([(s, t and s + t) for s, t in puts], 200)
    got = {}
    for r in expirations(spark, f"{tmp_path}/out", ["k"]).collect():
        got.setdefault(r.k, []).append((r.lsn - micros) // 1_000_000)
    if late is None:
        assert all(sorted(got.get(f"k{i}", [])) == gone for i in range(len(orders)))
    assert all(max(got.get(f"k{i}", [0])) == gone[-1] for i in range(len(orders)))
    assert {r.k for r in target.read(spark).collect()} == {"clock"} | ({f"k{i}" for i in range(len(orders))} if lives else set())


def test_a_put_that_comes_late_takes_a_written_end_back(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    schema = "k string, at timestamp_ntz, ttl int"
    target = KeyedTarget(f"{tmp_path}/entries", ["k"], ORDER, buckets=2)
    found = []
    for rows in ([("a", at(0), 100), ("x", at(200), None)], [("a", at(50), None)], [("a", at(60), 70)], [("a", at(130), 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream_expirations(read_changes(spark, f"{tmp_path}/in", schema), target, f"{tmp_path}/out", "at", F.col("ttl")).awaitTermination()
        ends = sorted(r.ts.second + 60 * r.ts.minute for r in expirations(spark, f"{tmp_path}/out", ["k"]).collect())
        found.append((ends, {r.k for r in target.read(spark).collect()}))
    assert found == [([100], {"x"}), ([], {"a", "x"}), ([130], {"x"}), ([135], {"x"})]


def test_origins_do_not_hide_each_other(spark, tmp_path):
    """Snapshots and a stream into one target, in any interleaving, with replays, give what the log gives."""
    changes = log_rows(60, 12, 5)
    log = [changes[i : i + 20] for i in range(0, 60, 20)]
    snapshot = [(k, f"snap{k}") for k in range(16)]
    first = {k: (k, "r", -1, v) for k, v in snapshot}
    want = first | {r[0]: r for r in sorted(changes, key=lambda r: r[2])}
    for seed in range(3):
        rng = random.Random(seed)
        steps = [("stream", i) for i in range(3)] + [("one", 0), ("one", 1), ("two", 0)]
        rng.shuffle(steps)
        steps.sort(key=lambda s: s[1])  # an origin's numbers rise
        target = KeyedTarget(f"{tmp_path}/t{seed}", ["id"], buckets=3)
        for origin, n in [x for step in steps for x in [step] * rng.choice([1, 2])]:
            if origin == "stream":
                target.buffer(spark.createDataFrame(log[n], LOG), n)
            else:
                rows = snapshot[8 * n : 8 * n + 8] if origin == "one" else snapshot
                load_snapshot(spark.createDataFrame(rows, "id bigint, v string"), target, origin, n)
            if rng.random() < 0.4:
                target.merge(spark)
        assert table(target, spark) == sorted(r for r in want.values() if r[1] != "d")


def test_chunks_of_a_snapshot_come_in_any_order(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=3)
    for n in (2, 2, 0, 3, 1, 0):
        load_snapshot(spark.range(4 * n, 4 * n + 4).selectExpr("id", "cast(id as string) v"), target, "one", n)
        target.buffer(spark.createDataFrame([(4 * n, "u", 5, "new")], LOG), n)
        target.merge(spark)
    assert [(r.id, r.v) for r in target.read(spark).orderBy("id").collect()] == [(k, "new" if k % 4 == 0 else str(k)) for k in range(16)]
    assert target.status(spark).manifest.through == {"one": [(0, 3)], "stream": [(0, 3)]} and not target.status(spark).pending
    assert target.holds(spark, 1, "one") and not target.holds(spark, 4, "one")


def test_origins_are_plain_names(spark, tmp_path):
    with pytest.raises(ValueError, match="origin"):
        KeyedTarget(f"{tmp_path}/t", ["id"], buckets=16).buffer(spark.createDataFrame([], LOG), 0, "a/b")


def test_keys_that_widen_stay_the_same_keys(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=4)
    target.buffer(spark.range(8).selectExpr("cast(id as int) as id", "'c' as op", "0L as lsn", "'a' as v"), 0)
    target.merge(spark)
    target.buffer(spark.range(8).selectExpr("cast(id as double) as id", "'u' as op", "1L as lsn", "'b' as v"), 1)
    for _ in range(2):
        assert [(r.id, r.v) for r in target.read(spark).orderBy("id").collect()] == [(i, "b") for i in range(8)]
        target.merge(spark)
    with pytest.raises(Exception, match="does not fit"):
        target.buffer(spark.createDataFrame([(1.5, "u", 2, "x")], "id double, op string, lsn bigint, v string"), 2)


def test_batches_bound_what_readers_apply(spark, tmp_path):
    for i in range(5):
        spark.createDataFrame([(i, "c", i, "v")], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2)
    stream = read_changes(spark, f"{tmp_path}/in", LOG, max_files=1)
    stream_apply(stream, target, every=None, merge_records=10**9, merge_batches=2).awaitTermination()
    assert len(target.status(spark).pending) == 1 and target.read(spark).count() == 5


def test_names_that_look_like_types_keep_their_values(spark):
    image = {"a: VOID": 1, "OBJECT<x": 2, "plain": None, "n": {"only": None}, "e": [], "VARIANT": "v"}
    batch = spark.createDataFrame([(1, json.dumps(image))], "id int, after string")
    got = expand_json(batch, 0).first().asDict()
    assert got == {"id": 1, "a: VOID": 1, "OBJECT<x": 2, "e": [], "VARIANT": "v"}


def test_quarantine(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("k bigint, s string")
    bodies = ['{"k":1,"s":"a"}', "{bad", '{"k":"no number"}', None, "{}", '{"k":2,"more":1}']
    raw = spark.createDataFrame(list(enumerate(bodies)), "i int, value string")
    good, bad = quarantine(raw, schema)
    assert sorted(r.i for r in bad.collect()) == [1, 2]
    assert {r.i: (r.k, r.s) for r in good.collect()} == {0: (1, "a"), 3: (None, None), 4: (None, None), 5: (2, None)}
    for _ in range(2):
        write_quarantined(raw, 0, schema, f"{tmp_path}/q")
    kept = spark.read.parquet(f"{tmp_path}/q")
    assert kept.filter("side = 'bad'").count() == 2
    assert kept.count() == 6


def _overtaken(monkeypatch, module, number, meanwhile):
    """Runs ``meanwhile`` once, just before the next commit of the kind."""
    real = module.commit
    done = []

    def commit(spark, log, kind, n, **columns):
        if kind == number and not done:
            done.append(True)
            meanwhile()
        return real(spark, log, kind, n, **columns)

    monkeypatch.setattr(module, "commit", commit)
    return done


@pytest.mark.parametrize("second_sees_first", [True, False])
def test_merges_at_the_same_time_lose_nothing(spark, tmp_path, monkeypatch, second_sees_first):
    """A writes its merge, B merges wholly, then A commits: A must start again."""
    from driftline.streaming import target as module

    one, two = (KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2) for _ in range(2))
    one.buffer(spark.createDataFrame([(1, "c", 1, "a")], LOG), 0, "one")
    early = one.status(spark)
    two.buffer(spark.createDataFrame([(2, "c", 1, "b")], LOG), 0, "two")

    def other():
        two.merge(spark, status=None if second_sees_first else module.Status(early.manifest, two.status(spark).pending[1:]))

    done = _overtaken(monkeypatch, module, "version", other)
    one.merge(spark, status=early)
    monkeypatch.undo()
    assert done
    for target in (one, two, KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2)):
        assert table(target, spark) == [(1, "c", 1, "a"), (2, "c", 1, "b")]
        target.merge(spark)
    assert not one.status(spark).pending


@pytest.mark.parametrize("merges", [1, 2, 3])
def test_a_batch_entered_while_others_merge_is_not_lost(spark, tmp_path, monkeypatch, merges):
    from driftline.streaming import target as module

    one, two = (KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2) for _ in range(2))
    two.buffer(spark.createDataFrame([(9, "c", 1, "z")], LOG), 0, "two")

    def other():
        for n in range(1, merges + 1):
            two.buffer(spark.createDataFrame([(9, "u", 1 + n, "z")], LOG), n, "two")
            two.merge(spark)

    batch = spark.createDataFrame([(1, "c", 1, "a")], LOG)
    done = _overtaken(monkeypatch, module, "batch", other)
    one.buffer(batch, 0, "one")
    monkeypatch.undo()
    assert done
    want = [(1, "c", 1, "a"), (9, "u", 1 + merges, "z")]
    assert table(KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2), spark) == want
    one.buffer(batch, 0, "one")  # a replay
    for n in range(3):
        two.buffer(spark.createDataFrame([], LOG), 10 + n, "two")
        two.merge(spark)
        assert table(two, spark) == want


def test_streams_that_merge_one_target_at_the_same_time(spark, tmp_path):
    rows = {o: [(k, "c", k, o) for k in range(i, 40, 2)] for i, o in enumerate(("one", "two"))}
    queries = []
    for origin, some in rows.items():
        land(spark, some, f"{tmp_path}/{origin}", 4)
        stream = read_changes(spark, f"{tmp_path}/{origin}", LOG, max_files=1)
        queries.append(stream_apply(stream, KeyedTarget(f"{tmp_path}/t", ["id"], buckets=3), every=None, origin=origin))
    for q in queries:
        q.awaitTermination()
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=3)
    assert table(target, spark) == sorted(r for some in rows.values() for r in some)
    assert target.status(spark).manifest.version >= 2


def test_the_log_that_is_read_stays_short(spark, tmp_path, monkeypatch):
    from driftline.streaming import target as module

    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2)
    read = []
    real = module.entries
    monkeypatch.setattr(module, "entries", lambda spark, paths, schema, root: read.append(paths) or real(spark, paths, schema, root))
    for n in range(12):
        target.buffer(spark.createDataFrame([(n, "c", n, "v")], LOG), n)
        if n % 3 == 2:
            target.merge(spark)
    read.clear()
    assert table(KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2), spark) == [(n, "c", n, "v") for n in range(12)]
    listed = [p for paths in read for p in paths if "/_batches/" in p]
    assert len(listed) == 2 and sum(len(list((tmp_path / "t" / "_batches" / p.rpartition("/")[2]).rglob("*.parquet"))) for p in listed) == 3
    assert target.status(spark).manifest.through == {"stream": [(0, 11)]}
    for path in [r.path for r in target.obsolete(spark).collect()]:
        shutil.rmtree(path)
    fresh = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2)
    assert fresh.read(spark).count() == 12 and fresh.holds(spark, 5)


def test_a_silent_stream_merges_its_last_batch(spark, tmp_path):
    name = "spark.sql.streaming.noDataProgressEventInterval"
    before = spark.conf.get(name)
    spark.conf.set(name, "200")
    target = KeyedTarget(f"{tmp_path}/t", ["id"], buckets=2)
    land(spark, [(1, "c", 1, "a"), (2, "c", 1, "b")], f"{tmp_path}/in", 1)
    stream = read_changes(spark, f"{tmp_path}/in", LOG)
    query = stream_apply(stream, target, every="100 milliseconds", merge_records=10**9, merge_seconds=2)
    try:
        def wait(done):
            deadline = time.monotonic() + 60
            while not done() and time.monotonic() < deadline:
                time.sleep(0.2)
            assert done()

        wait(lambda: target.exists(spark))
        began = time.monotonic()
        wait(lambda: not target.status(spark).pending and target.status(spark).manifest.version == 1)
        assert time.monotonic() - began < 30
        land(spark, [(2, "u", 2, "b2")], f"{tmp_path}/in", 1)
        wait(lambda: target.status(spark).manifest.version == 2)
        assert table(target, spark) == [(1, "c", 1, "a"), (2, "u", 2, "b2")]
    finally:
        query.stop()
        spark.conf.set(name, before)


def test_counts_follow_the_merges(spark, tmp_path, monkeypatch):
    from driftline.streaming import target as module

    target = KeyedTarget(f"{tmp_path}/t", ["tbl", "id"], buckets=3, count_by=["tbl"])
    rng = random.Random(2)
    kind = "tbl string, id bigint, op string, lsn bigint, v string"
    for n in range(5):
        rows = [(rng.choice("abc"), rng.randrange(15), rng.choice("cud"), 100 * n + i, "v") for i in range(30)]
        if n == 4:
            rows = [("a", i, "d", 1_000, None) for i in range(15)]
        target.buffer(spark.createDataFrame(rows, kind), n)
        target.merge(spark, compact=n == 2, forget_below=F.col("lsn") < 150 if n == 3 else None)
        whole = {r.tbl: r["count"] for r in target.read(spark).groupBy("tbl").count().collect()}
        with monkeypatch.context() as m:
            m.setattr(module.KeyedTarget, "_base", lambda *a: pytest.fail("rows are read"))
            counted = {r.tbl: r.n for r in target.counts(spark).collect()}
        assert counted == whole
    assert "a" not in counted
    with pytest.raises(ValueError, match="key"):
        KeyedTarget(f"{tmp_path}/u", ["id"], buckets=2, count_by=["v"])
    assert KeyedTarget(f"{tmp_path}/u", ["tbl", "id"], buckets=2, count_by=["tbl"]).counts(spark).count() == 0
