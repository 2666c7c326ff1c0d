"""Initial snapshots: key-ordered chunks, and the hand-over to the change stream."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.changes import drop_deleted, latest_per_key
from driftline.sessions import workspace

CHUNK_SIZE = 10_000
# Keys of a range: at most about so many, and at least so many unless one range holds them all.
KEYS_PER_RANGE, KEYS_PER_SMALL_RANGE = 10_000_000, 1_000
RANGES_PER_PARTITION, MOST_RANGES = 4, 1 << 14
# Borders that one tree of comparisons tells apart.
MOST_BRANCHES = 256
MOST_PRECISION = 65_535
BEFORE_STREAM = -1

_POSITION_BITS = 33  # monotonically_increasing_id() is the row number plus the partition number times 2^33


def snapshot_plan(
    df: DataFrame, key: str | Sequence[str], chunk_size: int = CHUNK_SIZE, partitions: int | None = None, within: Sequence[str] = ()
) -> DataFrame:
    """Chunk number, first key (``lo``), last key (``hi``) and row count; empty for an empty table.

    With several key columns ``lo`` and ``hi`` are records. Only the key is read and shuffled: it falls into ranges, is
    numbered within its range, and a range starts where the sizes of all ranges before it end. ``key`` is the table's
    primary key, hence unique and never hot. ``partitions`` is the number of ranges: by default some for each of the
    session's shuffle partitions, and as many as keep some ten million keys in each. No chunk holds keys that differ in the
    first columns ``within``: where they change a chunk is cut in two, which keep its number.

    The borders between ranges of whole numbers are quantiles of a sketch, taken in a pass of its own; no key is
    written. For keys of other types Spark finds the borders, and the numbered keys are written to the shared folder:
    all passes must see the same borders, also after a lost executor.
    """
    named = F.col(key) if isinstance(key, str) else F.struct(*key)
    keys = df.select(named.alias("_key"))
    whole = isinstance(keys.schema["_key"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    numbered = (_numbered_by_sketch if whole else _numbered_by_sort)(keys, partitions)
    # One row per range, at most as many as were asked for: small enough for one
    # window and for a broadcast by construction.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    chunk = F.expr(f"(_start + _pos) div {int(chunk_size)}")
    return (
        numbered.keys.join(F.broadcast(starts), "_part")
        .groupBy(*[F.col(f"_key.{c}").alias(f"_{c}") for c in within], chunk.alias("chunk"))
        .agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.count("*").alias("n"))
        .select("chunk", "lo", "hi", "n")
    )


class _Numbered(NamedTuple):
    """Keys with their range ``_part`` and their place ``_pos`` in it from 0 on, and the ``_size`` of each range."""

    keys: DataFrame
    sizes: DataFrame


def _ranges(keys: DataFrame, n: int) -> int:
    """Some ranges for each shuffle partition, so that these are even, but not for a handful of keys each."""
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(n / KEYS_PER_RANGE), min(RANGES_PER_PARTITION * partitions, n // KEYS_PER_SMALL_RANGE))


def _numbered_by_sketch(keys: DataFrame, partitions: int | None) -> _Numbered:
    # Largest sketch: a rank is wrong by some hundredth of a percent at most, and ranges by about their size.
    keys = keys.select(F.col("_key").cast("bigint").alias("_long"), "_key")
    n = keys.agg(F.count("*")).first()[0] if partitions is None else 0
    ranges = min(partitions or _ranges(keys, n), MOST_RANGES)
    if ranges > 1:
        precision = min(MOST_PRECISION, max(200, 16 * ranges))
        sketch = keys.agg(F.kll_sketch_agg_bigint("_long", precision).alias("s"))
        ranks = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        found = sketch.select(F.when(F.kll_sketch_get_n_bigint("s") > 0, F.kll_sketch_get_quantile_bigint("s", ranks))).first()[0]
        part = _range_of(F.col("_long"), sorted(set(found or [])))
    else:
        part = F.lit(0)
    placed = keys.select("_key", part.cast("bigint").alias("_part"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    in_range = Window.partitionBy("_part").orderBy("_key")
    return _Numbered(placed.withColumn("_pos", F.row_number().over(in_range).cast("bigint") - 1), sizes)


def _range_of(key: Column, borders: list[int], first: int = 0, most: int = MOST_BRANCHES) -> Column:
    """How many of the rising borders lie at or below the key, plus ``first``: halved by a tree of comparisons, which is
    compiled, and where there are too many for one, by a look through those that a branch leaves."""
    if not borders:
        return F.lit(first)
    if most < 2 and len(borders) > 1:
        left = F.expr(f"array({','.join(f'{b}L' for b in borders)})")
        return F.size(F.filter(left, lambda b: b <= key)) + first
    at = len(borders) // 2
    below, above = _range_of(key, borders[:at], first, most // 2), _range_of(key, borders[at + 1 :], first + at + 1, most // 2)
    return F.when(key < F.lit(borders[at]).cast("bigint"), below).otherwise(above)


def _numbered_by_sort(keys: DataFrame, partitions: int | None) -> _Numbered:
    spark = keys.sparkSession
    ranges = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(keys.count() / KEYS_PER_RANGE))
    part = F.spark_partition_id().cast("bigint")
    path = workspace(spark, "snapshot-keys")
    (
        keys.repartitionByRange(ranges, "_key")
        .sortWithinPartitions("_key")
        .select("_key", part.alias("_part"), (F.monotonically_increasing_id() - F.shiftleft(part, _POSITION_BITS)).alias("_pos"))
        .write.parquet(path)
    )
    written = spark.read.parquet(path)
    most = (1 << _POSITION_BITS) - 1
    n = F.count("*")
    size = F.when(n <= most, n).otherwise(F.raise_error(F.lit(f"a range holds more than {most} keys: ask for more partitions")))
    return _Numbered(written, written.groupBy("_part").agg(size.alias("_size")))


def snapshot_chunk(df: DataFrame, key: str | Sequence[str], lo: Any, hi: Any) -> DataFrame:
    """The rows of one chunk; the range of the (first) key column reaches the scan."""
    if isinstance(key, str):
        return df.filter(F.col(key).between(lo, hi))

    def record(values: Any):
        return F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(key, values, strict=True)])

    inside = F.struct(*key).between(record(lo), record(hi))
    return df.filter(F.col(key[0]).between(lo[0], hi[0]) & inside)


def handoff(
    snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], order: str = "lsn", tombstones: bool = False
) -> DataFrame:
    """Snapshot rows and the changes streamed meanwhile, as one state.

    A snapshot row ranks below every streamed change of its key, deletes included: it stays if its key has none.
    """
    newest = latest_per_key(changes, keys, [order])
    base = snapshot.withColumns({"op": F.lit("r"), order: F.lit(BEFORE_STREAM).cast(changes.schema[order].dataType)})
    changed = changes.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    untouched = base.join(changed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    state = untouched.select(*changes.columns).unionByName(newest)
    return state if tombstones else drop_deleted(state)
