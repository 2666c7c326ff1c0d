from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators.snapshot import snapshot_chunk, snapshot_plan
from driftline.sources.tables import range_bounds, ranges, scan_jdbc


@pytest.mark.parametrize(("n", "size"), [(0, 10), (1, 10), (10, 10), (11, 10), (2_503, 100)])
def test_plan_equals_slicing(spark, n, size):
    keys = random.Random(n).sample(range(10 * n + 1), n)
    df = spark.createDataFrame([(k,) for k in keys], "id bigint").repartition(5)
    keys.sort()
    want = [(i // size, keys[i], keys[min(i + size, n) - 1], min(size, n - i)) for i in range(0, n, size)]
    assert sorted(tuple(r) for r in snapshot_plan(df, "id", size).collect()) == want


def test_text_keys(spark):
    keys = sorted(f"k{i:04d}" for i in range(57))
    df = spark.createDataFrame([(k,) for k in keys], "code string")
    plan = sorted(tuple(r) for r in snapshot_plan(df, "code", 20).collect())
    assert plan == [(0, keys[0], keys[19], 20), (1, keys[20], keys[39], 20), (2, keys[40], keys[56], 17)]


def test_chunks_cover_the_table_once_and_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = snapshot_plan(orders, "o_orderkey", 400).collect()
    chunks = [snapshot_chunk(orders, "o_orderkey", r.lo, r.hi) for r in plan]
    assert [c.count() for c in chunks] == [r.n for r in plan]
    assert sum(r.n for r in plan) == orders.count()
    assert "GreaterThanOrEqual(o_orderkey" in chunks[0]._jdf.queryExecution().executedPlan().toString()


def test_composite_keys(spark):
    keys = [(t, i) for t in ("a", "b", "c") for i in range(7)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(t, i, f"{t}{i}") for t, i in keys], "tenant string, id int, v string").repartition(3)
    plan = sorted(snapshot_plan(df, ["tenant", "id"], 5).collect())
    keys.sort()
    assert [(tuple(r.lo), tuple(r.hi), r.n) for r in plan] == [
        (keys[i], keys[min(i + 5, 21) - 1], min(5, 21 - i)) for i in range(0, 21, 5)
    ]
    read = [r.v for p in plan for r in snapshot_chunk(df, ["tenant", "id"], p.lo, p.hi).orderBy("tenant", "id").collect()]
    assert read == [f"{t}{i}" for t, i in keys]


def test_ranges_as_text():
    assert ranges(["id"], []) == ["1 = 1"]
    assert ranges(["id"], [(5,), (9,)]) == [
        "(id IS NULL) OR NOT (id >= 5)",
        "id IS NOT NULL AND (id >= 5) AND NOT (id >= 9)",
        "id IS NOT NULL AND (id >= 9)",
    ]
    assert ranges(["a", "b"], [("x'y", 2)])[1] == "a IS NOT NULL AND b IS NOT NULL AND ((a > 'x''y' OR (a = 'x''y' AND b >= 2)))"


@pytest.mark.parametrize("most", [1, 2, 3, 100])
def test_ranges_cover_the_table_and_what_comes_later(spark, tmp_path, most):
    keys = [(t, i) for t in ("a", "b'", "c") for i in range(0, 21, 3)]
    spark.createDataFrame(keys, "tenant string, id int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = snapshot_plan(df, ["tenant", "id"], 4)
    conditions = ranges(["tenant", "id"], range_bounds(plan, ["tenant", "id"], most))
    assert len(conditions) <= most
    later = [("0", 1), ("b'", 4), ("z", 9), ("a", None), (None, 3), (None, None)]
    everything = df.union(spark.createDataFrame(later, df.schema))
    found = [tuple(r) for c in conditions for r in everything.filter(c).collect()]
    assert sorted(found, key=repr) == sorted([*keys, *later], key=repr)


def test_text_keys_need_a_byte_order(spark):
    plan = snapshot_plan(spark.createDataFrame([("a",)], "code string"), "code", 4)
    with pytest.raises(ValueError, match="bytes"):
        scan_jdbc(spark, "jdbc:none", "t", plan, ["code"])


def test_number_of_ranges(spark):
    plan = snapshot_plan(spark.range(1000), "id", 100, partitions=3)
    assert sorted((r.chunk, r.lo, r.hi) for r in plan.collect()) == [(i, 100 * i, 100 * i + 99) for i in range(10)]


@pytest.mark.parametrize("kind", ["bigint", "int"])
def test_whole_numbers_are_not_written(spark, monkeypatch, kind):
    """Skewed, negative and extreme keys, in many ranges; numbering needs no folder."""
    from driftline.operators import snapshot as module

    monkeypatch.setattr(module, "workspace", lambda *a: pytest.fail("keys are written"))
    monkeypatch.setattr(module, "KEYS_PER_SMALL_RANGE", 10)
    rng = random.Random(5)
    top = 2**63 - 1 if kind == "bigint" else 2**31 - 1
    keys = sorted({*(rng.randrange(-50, 400) for _ in range(500)), *(rng.randrange(-top, top) for _ in range(400)), top, -top - 1})
    df = spark.createDataFrame([(k,) for k in keys], f"id {kind}").repartition(3)
    want = [(i // 7, keys[i], keys[min(i + 7, len(keys)) - 1], min(7, len(keys) - i)) for i in range(0, len(keys), 7)]
    for partitions in (None, 1, 2, 3, 50):
        assert sorted(tuple(r) for r in snapshot_plan(df, "id", 7, partitions).collect()) == want


def test_range_of_a_key(spark):
    from driftline.operators.snapshot import _range_of

    rng = random.Random(1)
    for n, most in ((0, 256), (1, 256), (2, 256), (3, 256), (10, 256), (100, 256), (101, 1), (100, 4), (301, 64), (77, 2)):
        borders = sorted(rng.sample(range(-300, 300), n))
        keys = spark.range(-310, 310)
        part = _range_of(F.col("id"), borders, most=most)
        got = {r.id: r.part for r in keys.select("id", part.alias("part")).collect()}
        assert got == {k: sum(b <= k for b in borders) for k in range(-310, 310)}
        assert keys.filter(F.isnull("id") & (part > 0)).count() == 0
