"""Change records: unwrapping, ordering per key, and applying them to a table's state.

A change record is a flat row: the key columns, ``op`` (``r`` snapshot, ``c``, ``u``, ``d``), an order
such as ``lsn``, and the row image, which is NULL for deletes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unwrap(df: DataFrame, key: str = "key", after: str = "after", meta: Sequence[str] = ("op", "lsn", "ts")) -> DataFrame:
    """Envelope to flat record. A delete stays, with no image."""
    keys = df.schema[key].dataType.names
    image = [f for f in df.schema[after].dataType.names if f not in keys]
    gone = F.col("op") == "d"
    return df.select(
        f"{key}.*",
        *meta,
        *[F.when(~gone, F.col(f"{after}.`{f}`")).alias(f) for f in image],
    )


def exclude_columns(df: DataFrame, patterns: Sequence[str], table: str) -> DataFrame:
    """Drop the columns of ``table`` (``schema.table``) whose full name matches one of the patterns."""
    doomed = [c for c in df.columns if any(re.fullmatch(p, f"{table}.{c}") for p in patterns)]
    return df.drop(*doomed)


def nest_key(df: DataFrame, keys: Sequence[str], name: str = "id") -> DataFrame:
    """Carry the record key as one struct column in front of the value."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.struct(*keys).alias(name), *rest)


def flatten_key(df: DataFrame, name: str = "id") -> DataFrame:
    """Put ``id.id`` back as a plain column; a plain ``id`` is left alone."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StructType) and name in kind.names:
        return df.withColumn(name, F.col(f"{name}.{name}"))
    return df


def _records(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.MapType, T.VariantType))]


def normalise(df: DataFrame, types: dict[str, str], key: str = "id") -> DataFrame:
    """Record values ready for a relational insert: the key unwrapped, everything else JSON text."""
    if key in df.columns:
        df = flatten_key(df, key)
    keep_nulls = {"ignoreNullFields": "false"}
    return df.withColumns({c: F.to_json(c, keep_nulls) for c in _records(df)})


def unexpected_records(df: DataFrame, types: dict[str, str], key: str = "id") -> list[str]:
    """Columns holding records although the receiving column is not of a JSON type."""
    if key in df.columns:
        df = flatten_key(df, key)
    return [c for c in _records(df) if types.get(c) not in ("json", "jsonb")]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of every key by ``order``.

    An aggregate rather than a window: each task reduces a key to one record before the shuffle, so a
    key that holds a third of the log costs one record per task. Records that tie in ``order`` are told
    apart by their other columns, so that a replay gives the same result; columns that cannot be
    compared (maps, variants) leave such a tie open.
    """
    place = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in place]
    if any(_incomparable(df.schema[c].dataType) for c in rest):
        newest = F.max_by(F.struct(*place, *rest), F.struct(*place))
    else:
        newest = F.max(F.struct(*place, *rest))
    return df.groupBy(*keys).agg(newest.alias("_newest")).select(*keys, "_newest.*").select(*df.columns)


def _incomparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_incomparable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _incomparable(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def drop_deleted(df: DataFrame) -> DataFrame:
    """Without the keys whose last record is a delete."""
    return df.filter(F.col("op") != "d")


def apply_changes(
    state: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], few: bool = False, whole_keys: bool = False
) -> DataFrame:
    """The state after the changes, deletes kept as tombstones.

    ``state`` holds one record per key and both sides have the same columns. A change older than the
    state's record of its key is ignored. ``order`` is unique per key across batches, as positions of a log are:
    of records that tie, the last applied stays.

    One full outer join: the state and the changes are read once each. ``whole_keys`` promises that no key has a NULL
    part; a state that is bucketed by its keys is then not shuffled. Few changes leave any state where it is, see
    ``kept_and_fresh``.
    """
    if few:
        kept, fresh = kept_and_fresh(state, changes, keys, order)
        return kept.unionByName(fresh)
    newest = latest_per_key(changes.select(*state.columns), keys, order)
    old = state.withColumn("_there", F.lit(True)).alias("_old")
    new = newest.withColumn("_there", F.lit(True)).alias("_new")
    of = lambda side, c: F.col(f"{side}.`{c}`")
    same_key = [of("_old", k) == of("_new", k) if whole_keys else of("_old", k).eqNullSafe(of("_new", k)) for k in keys]
    # records compare with NULL as the least
    place = lambda side: F.struct(*[of(side, c) for c in order])
    takes = of("_old", "_there").isNull() | (of("_new", "_there").isNotNull() & (place("_new") >= place("_old")))
    joined = old.join(new, same_key, "full_outer")
    return joined.select(*[F.when(takes, of("_new", c)).otherwise(of("_old", c)).alias(c) for c in state.columns])


def kept_and_fresh(state: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The state's records that stay, and the changes that take effect, for few changes.

    The state is only filtered by the keys of the changes. These are broadcast, with their order, and the state
    is not shuffled at all: the caller has bounded their number and bytes.
    """
    newest = latest_per_key(changes.select(*state.columns), keys, order)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    # The newest place per key is aggregated apart: it needs no row images, only keys and order.
    mark = changes.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(place).alias("_newest"))
    # Neither the marks nor the late keys are more than the changes.
    small = F.broadcast
    # A NULL key part equals another one, as it does where records are grouped.
    same_key = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    mark = small(mark)
    replaced = place.isNull() | F.coalesce(F.col("_newest") >= place, F.lit(False))
    kept = state.join(mark, [*same_key, replaced], "left_anti")
    late = state.select(*keys, *order).join(mark, [*same_key, ~replaced], "left_semi").select(*[F.col(k).alias(f"_{k}") for k in keys])
    return kept, newest.join(small(late), same_key, "left_anti")
