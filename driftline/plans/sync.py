"""Start and retirement of pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.names import SINK_PIPELINE, SOURCE_PIPELINE, TABLE, named


def with_status(tables: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Add ``source_exists`` and ``sink_exists`` from a relation of pipelines (``kind`` source or sink)."""
    present = pipelines.groupBy(*TABLE).agg(
        F.max(F.col("kind") == "source").alias("_source"), F.max(F.col("kind") == "sink").alias("_sink")
    )
    return tables.join(present, list(TABLE), "left").select(
        *tables.columns,
        F.coalesce("_source", F.lit(False)).alias("source_exists"),
        F.coalesce("_sink", F.lit(False)).alias("sink_exists"),
    )


def sync_plan(tables: DataFrame) -> DataFrame:
    """The action per table and what goes with it.

    ``tables`` carries ``annotation``, ``source_exists``, ``sink_exists``, ``target_exists`` and
    ``source_count``. A new pipeline whose target already exists first loads the source from it; a
    source that is created over existing rows asks for a snapshot.
    """
    on = F.coalesce("annotation.enabled", F.lit(False))
    source, sink = F.col("source_exists"), F.col("sink_exists")
    action = (
        F.when(~on, "skip")
        .when(~source & ~sink, "full_setup")
        .when(~sink, "add_sink")
        .when(~source, "add_source")
        .otherwise("ok")
    )
    complete = F.col("annotation.target_schema").isNotNull() & F.col("annotation.target_table").isNotNull()
    setup = F.col("action").isin("full_setup", "add_sink", "add_source")
    rows = F.coalesce("source_count", F.lit(0)) > 0
    return (
        tables.withColumn("action", action)
        .withColumn("needs_backfill", (F.col("action") == "full_setup") & F.col("target_exists"))
        .withColumn("needs_snapshot", F.col("action").isin("full_setup", "add_source") & rows)
        .withColumn("capture_count", (F.col("action") == "full_setup") & rows)
        .withColumn("problem", F.when(setup & ~F.coalesce(complete, F.lit(False)), "target_incomplete"))
    )


def retire_plan(tables: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """One row per object to remove, with its ``name``, for tables that are disabled or not annotated, the target first.

    ``remembered`` (``target_schema``, ``target_table`` per table) tells the targets as they were named when the
    pipelines started: an annotation that has vanished names none, and one that has changed names another. A target
    that neither names has no name here. ``shared`` marks a sink whose name a table that stays has as well: names of
    sinks leave the schema out.
    """
    fleet = tables.withColumn("_on", F.coalesce("annotation.enabled", F.lit(False)))
    kept = fleet.filter("_on").select(named(SINK_PIPELINE).alias("_sink")).distinct().withColumn("_kept", F.lit(True))
    off = fleet.filter(~F.col("_on")).withColumn("_sink", named(SINK_PIPELINE)).join(kept, "_sink", "left")
    known = F.lit(None).cast("string")
    if {"target_schema", "target_table"} <= set(tables.schema["annotation"].dataType.names):
        # NULL unless both parts are there
        known = F.concat("annotation.target_schema", F.lit("."), "annotation.target_table")
    if remembered is not None:
        old = remembered.select(*TABLE, F.concat_ws(".", "target_schema", "target_table").alias("_target"))
        off = off.join(old, list(TABLE), "left")
        known = F.coalesce("_target", known)

    def step(n: int, kind: str, name: Column, shared: Column) -> Column:
        there = F.col(f"{kind}_exists").alias("there")
        return F.struct(F.lit(n).alias("step"), F.lit(kind).alias("object"), name.alias("name"), shared.alias("shared"), there)

    steps = F.array(
        step(1, "target", known, F.lit(False)),
        step(2, "source", named(SOURCE_PIPELINE), F.lit(False)),
        step(3, "sink", F.col("_sink"), F.coalesce("_kept", F.lit(False))),
    )
    todo = off.select(*TABLE, F.explode(F.filter(steps, lambda s: s["there"])).alias("_s"))
    return todo.select(*TABLE, "_s.step", "_s.object", "_s.name", "_s.shared")
