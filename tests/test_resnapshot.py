"""Tables that are read again while their streams run."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators.signals import signals_for, snapshot_requests
from driftline.streaming.apply import load_snapshot
from driftline.streaming.resnapshot import MOST_WINDOWS, chunk_in_window, request_chunks, resnapshot
from driftline.streaming.target import KeyedTarget

LOG = "database string, schema string, tbl string, id bigint, op string, lsn bigint, v string"
ROWS = "database string, schema string, tbl string, id bigint, v string"
KEYS = ["database", "schema", "tbl", "id"]
TABLES = [("d", "s", "a"), ("d", "s", "b"), ("e", "s", "a")]


def history(seed, n=120):
    """Changes of three tables, a third of them on one key, with unique positions."""
    rng = random.Random(seed)
    rows = []
    for lsn in range(1, n + 1):
        t, k = rng.choice(TABLES), 0 if rng.random() < 1 / 3 else rng.randrange(12)
        op = rng.choice("cuud")
        rows.append((*t, k, op, lsn, None if op == "d" else f"v{lsn}"))
    return rows


def state(rows, position=1 << 60):
    out = {}
    for r in rows:
        if r[5] <= position:
            out[r[:4]] = r
    return {k: r for k, r in out.items() if r[4] != "d"}


def requests(spark, tables):
    catalog = spark.createDataFrame(TABLES, "database string, schema string, tbl string")
    asked = spark.createDataFrame(tables, "database string, schema string, tbl string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return snapshot_requests(signals_for(asked), catalog)


def read(target, spark):
    return {(r.database, r.schema, r.tbl, r.id): r.v for r in target.read(spark).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_any_interleaving_gives_the_batch_result(spark, tmp_path, seed):
    """A target that missed changes, and holds rows that are gone; streams, merges, crashes and windows as they come."""
    rng = random.Random(seed)
    rows = history(seed)
    target = KeyedTarget(f"{tmp_path}/t", KEYS, buckets=3)
    early = [(*k, r[6]) for k, r in state(rows, 30).items()]
    ghosts = [(*t, 90 + i, "ghost") for i, t in enumerate(TABLES)]
    load_snapshot(spark.createDataFrame(early + ghosts, ROWS), target, "initial")
    at = {"source": 60, "stream": 60, "batch": 0}

    def move(most):
        for _ in range(rng.randrange(most)):
            if rng.random() < 0.6:
                at["source"] = min(len(rows), at["source"] + rng.randrange(1, 12))
            elif at["stream"] < at["source"]:
                to = rng.randrange(at["stream"], at["source"]) + 1
                part = [r for r in rows if at["stream"] < r[5] <= to]
                rng.shuffle(part)
                target.buffer(spark.createDataFrame(part, LOG), at["batch"])
                at["stream"], at["batch"] = to, at["batch"] + 1
            if rng.random() < 0.2:
                target.merge(spark)

    def source():
        if rng.random() < 0.15:
            raise ConnectionError("the source is away")
        move(4)
        got = [(*k, r[6]) for k, r in state(rows, at["source"]).items()]
        move(3)
        return spark.createDataFrame(got, ROWS)

    windows = []
    asked = requests(spark, TABLES[:2])
    done = False
    for _ in range(40):
        try:
            n = resnapshot(asked, source, lambda: at["source"], target, "again", chunk_size=2, chunks_per_window=2, window_read=windows.append)
            done = True
            break
        except ConnectionError:
            continue
    assert done and n >= 3 and [w.number for w in windows] == list(range(n)) and all(w.low <= w.high for w in windows)
    at["source"] = len(rows)
    rest = [r for r in rows if at["stream"] < r[5]]
    target.buffer(spark.createDataFrame(rest, LOG), at["batch"])
    whole, missed = state(rows), state([r for r in rows if r[5] <= 30 or r[5] > 60])
    want = {k: r[6] for k, r in whole.items() if k[:3] in TABLES[:2]} | {k: r[6] for k, r in missed.items() if k[:3] == TABLES[2]}
    want[*TABLES[2], 92] = "ghost"
    assert read(target, spark) == want
    target.merge(spark)
    assert read(target, spark) == want
    assert resnapshot(asked, source, lambda: 0, target, "again", chunk_size=2, chunks_per_window=2) == n  # nothing is read again


def test_chunks_of_requested_tables(spark):
    rows = spark.createDataFrame([(*t, k, "v") for t in TABLES for k in range(7)], ROWS)
    plan = request_chunks(requests(spark, [TABLES[0], TABLES[2]]), rows, ["id"], 5)
    got = sorted((r.database, r.tbl, r.chunk, r.lo.id, r.hi.id, r.n) for r in plan.collect())
    assert got == [("d", "a", 0, 0, 4, 5), ("d", "a", 1, 5, 6, 2), ("e", "a", 1, 0, 2, 3), ("e", "a", 2, 3, 6, 4)]
    assert request_chunks(requests(spark, [TABLES[0]]), rows.limit(0), ["id"]).count() == 0


def test_a_requested_table_that_is_empty_now(spark, tmp_path):
    target = KeyedTarget(f"{tmp_path}/t", KEYS, buckets=2)
    load_snapshot(spark.createDataFrame([(*t, 1, "old") for t in TABLES], ROWS), target, "initial")
    nothing = spark.createDataFrame([], ROWS)
    assert resnapshot(requests(spark, TABLES[:1]), lambda: nothing, lambda: 5, target, "again") == 0
    assert set(read(target, spark)) == {(*t, 1) for t in TABLES[1:]}
    with pytest.raises(ValueError, match="identity"):
        resnapshot(requests(spark, TABLES[:1]), lambda: nothing, lambda: 5, KeyedTarget(f"{tmp_path}/u", ["id"], buckets=2), "again")
    with pytest.raises(ValueError, match="origin"):
        resnapshot(requests(spark, TABLES[:1]), lambda: nothing, lambda: 5, target, "a/b")


def test_the_number_of_windows_is_bounded(spark, tmp_path):
    """However many chunks there are, the source is read for few windows, which bring every row."""
    rows = spark.createDataFrame([(*t, k, "new") for t in TABLES for k in range(40)], ROWS)
    target = KeyedTarget(f"{tmp_path}/t", KEYS, buckets=2)
    load_snapshot(rows.withColumn("v", F.lit("old")), target, "initial")
    windows = []
    asked = requests(spark, TABLES[:2])
    n = resnapshot(asked, lambda: rows, lambda: 5, target, "again", chunk_size=1, chunks_per_window=2, window_read=windows.append)
    assert n == len(windows) == MOST_WINDOWS < 80 / 2
    assert all(a.hi < b.lo for a, b in zip(windows, windows[1:], strict=False))
    assert read(target, spark) == {(*t, k): "old" if t == TABLES[2] else "new" for t in TABLES for k in range(40)}
    assert resnapshot(asked, lambda: rows, lambda: 9, target, "again", chunk_size=1, chunks_per_window=2) == n  # nothing is read again


@pytest.mark.parametrize("seed", range(3))
def test_windows_for_a_target_that_goes_by_arrival(spark, seed):
    """What a window leaves of its chunk, put into the stream at the high mark, gives what the log gives."""
    rng = random.Random(seed)
    rows = [r for r in history(seed) if r[:3] == TABLES[0]]
    log = spark.createDataFrame(rows, LOG)
    low = rng.randrange(20, 60)
    read_at = low + rng.randrange(0, 20)
    high = read_at + rng.randrange(0, 20)
    chunk = spark.createDataFrame([(*k, r[6]) for k, r in state(rows, read_at).items()], ROWS)
    left = [(r.id, r.v) for r in chunk_in_window(chunk, log, ["id"], low, high).collect()]
    by_arrival = {}
    start = low  # what came before is lost
    for r in [x for x in rows if start < x[5] <= high]:
        by_arrival[r[3]] = r
    for k, v in left:
        by_arrival[k] = (*TABLES[0], k, "r", high, v)
    for r in [x for x in rows if x[5] > high]:
        by_arrival[r[3]] = r
    assert {k: r[6] for k, r in by_arrival.items() if r[4] != "d"} == {k[3]: r[6] for k, r in state(rows).items()}
