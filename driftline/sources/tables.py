"""Tables and queries."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, ref: str) -> DataFrame:
    """All rows of a catalog table, or of the Parquet files under a path."""
    return spark.read.parquet(ref) if "/" in ref else spark.table(ref)


def save_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Save a table in ``buckets`` buckets by its keys, one sorted file each, and return it.

    Joins by the keys find its rows where they belong: no exchange moves them. ``buckets`` is fixed for the table;
    choose it so that one holds some gigabytes at most.
    """
    balanced = df.repartition(buckets, *keys)
    balanced.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def _literal(value: Any) -> str:
    return str(value) if isinstance(value, (int, Decimal)) else "'" + str(value).replace("'", "''") + "'"


def _from(keys: Sequence[str], bound: Sequence[Any]) -> str:
    """The condition that a composite key is at or after a bound, column by column."""
    (key, *later), (value, *rest) = keys, bound
    at = _literal(value)
    return f"{key} >= {at}" if not later else f"({key} > {at} OR ({key} = {at} AND {_from(later, rest)}))"


def ranges(keys: Sequence[str], bounds: Sequence[Sequence[Any]]) -> list[str]:
    """Conditions that cut a table at rising bounds, each row in exactly one of them.

    They are half open and cover the whole line, rows without a key and rows that come in after planning
    included.
    """
    if not bounds:
        return ["1 = 1"]
    starts = [_from(keys, b) for b in bounds]
    nothing = " OR ".join(f"{k} IS NULL" for k in keys)
    first = f"({nothing}) OR NOT ({starts[0]})"
    whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    inner = [f"{whole} AND ({a}) AND NOT ({b})" for a, b in zip(starts, starts[1:], strict=False)]
    return [first, *inner, f"{whole} AND ({starts[-1]})"]


def range_bounds(plan: DataFrame, keys: Sequence[str], most: int) -> list[tuple]:
    """The first keys of at most ``most`` runs of chunks of a snapshot plan, but for that of the first run."""
    last = plan.agg(F.max("chunk")).first()[0] or 0
    step = -(-(last + 1) // most)
    lo = [F.col("lo")] if len(keys) == 1 else [F.col(f"lo.{k}") for k in keys]
    starts = plan.filter((F.col("chunk") > 0) & (F.col("chunk") % step == 0))
    return [tuple(r) for r in starts.orderBy("chunk").select(*lo).collect()]


def scan_jdbc(
    spark: SparkSession, url: str, table: str, plan: DataFrame, keys: Sequence[str], tasks: int = 200, byte_order: bool = False, **options: str
) -> DataFrame:
    """A table behind a JDBC driver, read by at most ``tasks`` tasks that share the chunks of its snapshot plan.

    Text keys are cut in Spark's order of bytes. Say ``byte_order`` if the database compares them so, too;
    under another collation ranges would overlap.
    """
    text = [k for k in keys if isinstance(_key_type(plan, k, len(keys)), T.StringType)]
    if text and not byte_order:
        raise ValueError(f"text keys need a database that compares bytes: {text}")
    return spark.read.jdbc(url, table, predicates=ranges(keys, range_bounds(plan, keys, tasks)), properties=options)


def _key_type(plan: DataFrame, key: str, keys: int) -> T.DataType:
    kind = plan.schema["lo"].dataType
    return kind if keys == 1 else kind[key].dataType


def query(spark: SparkSession, sql: str, args: dict[str, Any] | None = None, **views: DataFrame) -> DataFrame:
    """Parameterised SQL (``:name`` markers) over catalog tables and the given DataFrames (``{name}``)."""
    return spark.sql(sql, args=args, **views)
