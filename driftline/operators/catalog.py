"""Which tables take part: databases, tables, keys, ids, stream coverage.

A table is identified by (``database``, ``schema``, ``tbl``). All relations carry the database, so
one job covers the whole fleet where a control program would query table by table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.annotations import parse_annotations
from driftline.functions.names import TABLE

# Databases and schemas that never take part, and the signal table itself.
EXCLUDED_DATABASES = ("postgres", "template0", "template1")
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast")
SIGNAL_TABLE = ("public", "debezium_signal")


def exclusions(names: str | Sequence[str]) -> list[str]:
    """Exact names, from a list or from one comma-separated text."""
    parts = names.split(",") if isinstance(names, str) else names
    return [p.strip() for p in parts if p.strip()]


def discover_databases(
    databases: DataFrame, excluded: str | Sequence[str] | DataFrame = EXCLUDED_DATABASES
) -> DataFrame:
    """Non-template databases minus the excluded ones (names, or a relation with ``datname``)."""
    candidates = databases.filter(~F.col("datistemplate"))
    if isinstance(excluded, DataFrame):
        candidates = candidates.join(excluded.select("datname"), "datname", "left_anti")
    else:
        candidates = candidates.filter(~F.col("datname").isin(exclusions(excluded)))
    return candidates.select("datname")


def discover_tables(
    tables: DataFrame, classes: DataFrame, namespaces: DataFrame, database: str | None = None
) -> DataFrame:
    """Base tables outside the system schemas with their comment, by schema and name."""
    base = tables.filter(
        (F.col("table_type") == "BASE TABLE")
        & ~F.col("schema").isin(*SYSTEM_SCHEMAS)
        & ~((F.col("schema") == SIGNAL_TABLE[0]) & (F.col("tbl") == SIGNAL_TABLE[1]))
    )
    if database is not None:
        base = base.filter(F.col("database") == database)
    named = classes.join(namespaces, ["database", "namespace_oid"]).select("database", "schema", "tbl", "comment")
    return base.select(*TABLE).join(named, list(TABLE)).orderBy("schema", "tbl", "database")


def qualify_keys(
    tables: DataFrame, constraints: DataFrame, key_columns: DataFrame, columns: DataFrame, column: str = "id"
) -> DataFrame:
    """Add ``qualifies``, ``reason`` and ``pk_columns`` (in key order).

    A table qualifies if its primary key contains ``column``. The list per key is bounded by the
    32 columns a source index may have.
    """
    primary = (
        constraints.filter(F.col("constraint_type") == "PRIMARY KEY")
        .select(*TABLE, "constraint_name")
        .join(key_columns, [*TABLE, "constraint_name"])
        .groupBy(*TABLE)
        .agg(F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("_pk"))
        .select(*TABLE, F.transform("_pk", lambda c: c["column_name"]).alias("pk_columns"))
    )
    with_column = with_existence(
        tables, columns.filter(F.col("column_name") == column), "_has_column", TABLE
    )
    in_key = F.array_contains("pk_columns", column)
    reason = (
        F.when(F.col("pk_columns").isNull(), "no_primary_key")
        .when(~F.col("_has_column"), "no_id_column")
        .when(~in_key, "id_not_in_key")
        .when(F.size("pk_columns") == 1, "single")
        .otherwise("composite")
    )
    return (
        with_column.join(primary, list(TABLE), "left")
        .withColumn("reason", reason)
        .withColumn("qualifies", F.col("reason").isin("single", "composite"))
        .drop("_has_column")
    )


def enabled(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("annotation.enabled", F.lit(False)))


def not_enabled(df: DataFrame) -> DataFrame:
    """Disabled tables and tables without annotation."""
    return df.filter(~F.coalesce("annotation.enabled", F.lit(False)))


def resolve_table_ids(tables: DataFrame, listing: DataFrame) -> DataFrame:
    """Add ``table_id``; tables listed under no id or several are left out."""
    unique = (
        listing.groupBy(*TABLE)
        .agg(F.count("*").alias("_n"), F.first("table_id").alias("table_id"))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )
    return tables.join(unique, list(TABLE))


def covered_tables(tables: DataFrame, stream_tables: DataFrame, streams: DataFrame) -> DataFrame:
    """Tables (with ``table_id``) listed on the stream of their database; no stream, no tables."""
    with_stream = tables.join(lookup_stream(streams), "database")
    listed = stream_tables.select("stream_id", "table_id").distinct()
    return with_stream.join(listed, ["stream_id", "table_id"], "left_semi").select(*tables.columns, "stream_id")


def lookup_stream(streams: DataFrame) -> DataFrame:
    """The first stream registered for each database."""
    first = F.min_by("stream_id", F.struct("created_at", "stream_id"))
    return streams.groupBy("database").agg(first.alias("stream_id"))


def register_streams(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after putting each new stream whose database has none yet."""
    first = (
        new.groupBy("database")
        .agg(F.min_by(F.struct(*[c for c in registry.columns if c != "database"]), F.struct("created_at", "stream_id")).alias("_s"))
        .select("database", "_s.*")
    )
    absent = first.join(registry.select("database").distinct(), "database", "left_anti")
    return registry.unionByName(absent.select(*registry.columns))


def with_existence(
    tables: DataFrame, inventory: DataFrame, flag: str, on: Sequence[str] = TABLE
) -> DataFrame:
    """Add a flag that tells whether the inventory lists the table."""
    listed = inventory.select(*on).distinct().withColumn("_listed", F.lit(True))
    joined = tables.join(listed, list(on), "left")
    return joined.withColumn(flag, F.coalesce("_listed", F.lit(False))).drop("_listed").select(*tables.columns, flag)


def column_types(columns: DataFrame) -> DataFrame:
    """Column name to type, one map per table (a source table has at most 1,600 columns)."""
    entries = F.collect_list(F.struct("column_name", "data_type"))
    return columns.groupBy(*TABLE).agg(F.map_from_entries(entries).alias("types"))


def discover_candidates(
    tables: DataFrame,
    classes: DataFrame,
    namespaces: DataFrame,
    constraints: DataFrame,
    key_columns: DataFrame,
    columns: DataFrame,
    listing: DataFrame,
    stream_tables: DataFrame,
    streams: DataFrame,
) -> DataFrame:
    """Tables that can be replicated, with annotation, id and stream: the whole discovery as one plan."""
    found = discover_tables(tables, classes, namespaces)
    qualified = qualify_keys(found, constraints, key_columns, columns).filter("qualifies")
    return covered_tables(resolve_table_ids(parse_annotations(qualified), listing), stream_tables, streams)
