"""Tracked configuration: comparison of two catalogs, totals and the per-table report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from driftline.functions.names import TABLE
from driftline.functions.times import moment, seconds


def config_hash(annotation: str = "annotation") -> Column:
    """SHA-256 over the configuration; NULL fields count as empty text."""
    config = F.struct(
        F.coalesce(f"{annotation}.enabled", F.lit(False)).alias("enabled"),
        F.coalesce(f"{annotation}.target_schema", F.lit("")).alias("target_schema"),
        F.coalesce(f"{annotation}.target_table", F.lit("")).alias("target_table"),
    )
    return F.sha2(F.to_json(config), 256)


def state_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change`` per table: added, removed, enabled, disabled, changed or same."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        on = F.coalesce("annotation.enabled", F.lit(False))
        return df.select(*TABLE, config_hash().alias(f"{tag}_hash"), on.alias(f"_{tag}_on"))

    both = side(old, "old").join(side(new, "new"), list(TABLE), "full_outer")
    change = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "same")
        .when(~F.col("_old_on") & F.col("_new_on"), "enabled")
        .when(F.col("_old_on") & ~F.col("_new_on"), "disabled")
        .otherwise("changed")
    )
    return both.select(*TABLE, "old_hash", "new_hash", change.alias("change"))


def summary(state: DataFrame, at: str | datetime | Column, recent_hours: int = 24) -> DataFrame:
    """Totals over the tracked tables, in one pass."""
    on = F.coalesce("annotation.enabled", F.lit(False))
    recent = F.col("updated_at") >= moment(at, state, "updated_at") - seconds(recent_hours * 3600)
    return state.agg(
        F.count("*").alias("tracked"),
        F.count_if(on).alias("enabled"),
        F.count_if(F.col("source_exists") & F.col("sink_exists")).alias("running"),
        F.count_if(recent).alias("recent"),
        F.max("updated_at").alias("last_update"),
    )


def _counters() -> list[Column]:
    return [
        F.count("*").alias("scanned"),
        F.count_if(F.col("action") == "ok").alias("in_sync"),
        F.count_if(F.col("action").isin("full_setup", "add_sink", "add_source") & F.col("problem").isNull()).alias("to_sync"),
        F.count_if(F.col("problem").isNotNull()).alias("errors"),
        F.count_if(F.col("source_exists") & F.col("sink_exists")).alias("active"),
    ]


def scan_counters(plan: DataFrame) -> DataFrame:
    """Counters of one scan, from its plan (``sync_plan``)."""
    return plan.agg(*_counters())


def observed(plan: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The plan itself, and the same counters once some action has run over it."""
    counters = Observation(name)
    return plan.observe(counters, *_counters()), counters


def report(state: DataFrame) -> DataFrame:
    """Configuration, target, pipeline status and last update per table."""
    on = F.when(F.col("annotation").isNull(), "none").when(F.col("annotation.enabled"), "enabled").otherwise("disabled")
    pipeline = (
        F.when(F.col("source_exists") & F.col("sink_exists"), "running")
        .when(F.col("source_exists") | F.col("sink_exists"), "partial")
        .otherwise("absent")
    )
    target = F.concat_ws(".", "annotation.target_schema", "annotation.target_table")
    return state.select(
        *TABLE,
        on.alias("config"),
        F.nullif(target, F.lit("")).alias("target"),
        pipeline.alias("pipeline"),
        F.col("updated_at").alias("last_update"),
    )
