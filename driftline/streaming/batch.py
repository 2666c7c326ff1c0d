"""Batch sinks: append by name, and replacing all rows of a table."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from driftline.operators.changes import normalise, unexpected_records
from driftline.operators.schema import ordered
from driftline.streaming.commits import attempt, commit, committed, latest

_VERSIONS = "folder string, version bigint"


def append(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Append the target's columns, matched by name; an empty input adds no rows."""
    df.select(*(columns or df.columns)).write.mode("append").parquet(path)


def replace_all(df: DataFrame, path: str, allow_empty: bool = False) -> int:
    """Reload a table from ``df`` (which may read the table itself) and return the new version.

    The rows are staged as a new version and only then become current, so the old rows stay readable
    until the load is complete. An empty load is refused unless allowed. Of loads that run at the same time the one
    that ends last stays.
    """
    spark = df.sparkSession
    version = (current_version(spark, path) or 0) + 1
    folder = f"version={attempt(version)}"
    df.write.parquet(f"{path}/{folder}")
    # The staged rows are looked at, so that the load is computed once.
    if not allow_empty and spark.read.parquet(f"{path}/{folder}").isEmpty():
        raise ValueError("refusing to replace a table by nothing")
    while not commit(spark, f"{path}/_versions", "version", version, folder=[folder]):
        version = latest(spark, f"{path}/_versions", "version", version) + 1
    return version


def backfill(target: DataFrame, path: str, types: dict[str, str], columns: str | list[str]) -> int:
    """Load a source back from its target: records made relational, then all rows replaced.

    ``types`` are the source's column types, ``columns`` its columns in order. Records in columns that are not of a JSON
    type come as JSON text, with a warning that names the columns.
    """
    if odd := unexpected_records(target, types):
        logging.getLogger(__name__).warning("records in columns that are not of a JSON type: %s", ", ".join(odd))
    return replace_all(ordered(normalise(target, types), columns), path)


def current_version(spark: SparkSession, path: str) -> int | None:
    return latest(spark, f"{path}/_versions", "version") or None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current version."""
    version = current_version(spark, path)
    if version is None:
        raise ValueError(f"nothing committed under {path}")
    entry = committed(spark, f"{path}/_versions/version={version}", _VERSIONS)
    return spark.read.parquet(f"{path}/{entry.first().folder}")
