"""Where a table's changes go, and under which names."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.names import SERVER, SINK_PIPELINE, SOURCE_PIPELINE, TABLE, TOPIC, named

# The problem that the sync plan names, too.
INCOMPLETE = "target_incomplete"
BUCKET = "_bucket"


def routes(tables: DataFrame) -> DataFrame:
    """Server, topic, target and pipeline names per annotated table, with ``status`` and ``error``."""
    complete = F.col("annotation.target_schema").isNotNull() & F.col("annotation.target_table").isNotNull()
    plan = tables.select(
        *TABLE,
        named(SERVER).alias("server"),
        named(TOPIC).alias("topic"),
        named(SOURCE_PIPELINE).alias("source_pipeline"),
        named(SINK_PIPELINE).alias("sink_pipeline"),
        F.col("annotation.target_schema").alias("target_schema"),
        F.col("annotation.target_table").alias("target_table"),
        F.coalesce(complete, F.lit(False)).alias("_complete"),
    )
    return with_outcome(plan, {INCOMPLETE: F.col("_complete")}).drop("_complete")


def with_outcome(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Add ``status`` and ``error`` per row: the first check that does not hold, instead of an exception."""
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks.items()])
    return df.withColumn("error", failed).withColumn("status", F.when(failed.isNull(), "ok").otherwise("failed"))


def for_all(databases: Mapping[str, DataFrame]) -> DataFrame:
    """Relations kept per database as one, each row keyed by its database.

    For dumps that lie in one place per database. Relations that already carry the database need no
    union: every operator here takes the whole fleet at once.
    """
    keyed = [df.withColumn("database", F.lit(name)) for name, df in databases.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), keyed)


def route(changes: DataFrame, plan: DataFrame) -> DataFrame:
    """Changes of a mixed stream with the target of their table; tables without a valid target drop out.

    The plan has one row per table. Spark broadcasts it only if it is small; otherwise the skew join
    splits the table that holds most of the changes.
    """
    valid = plan.filter(F.col("status") == "ok").select(*TABLE, "topic", "target_schema", "target_table")
    return changes.join(valid, list(TABLE))


def write_routed(changes: DataFrame, path: str, batch_id: int, buckets: int | None = None) -> None:
    """Routed changes written in one job rather than one per table.

    One folder per target, or with ``buckets`` so many folders at most, whatever the number of targets: a stream of a
    fleet then leaves no file per target and micro-batch. Within a bucket rows are sorted by target, so that a reader of
    one skips the others by the statistics of the files. Rebalancing keeps the number of files low and splits the folder
    that takes the most. A micro-batch that is replayed replaces what it wrote before.
    """
    target = ["target_schema", "target_table"]
    folders = target
    if buckets is not None:
        folders = [BUCKET]
        changes = changes.withColumn(BUCKET, F.pmod(F.xxhash64(*target), F.lit(buckets)))
    balanced = changes.hint("rebalance", *[F.col(c) for c in folders])
    if buckets is not None:
        balanced = balanced.sortWithinPartitions(BUCKET, *target)
    balanced.write.mode("overwrite").partitionBy(*folders).parquet(f"{path}/batch={batch_id}")


def read_routed(spark: SparkSession, path: str, schema: T.StructType | str, target: tuple[str, str] | None = None) -> DataFrame:
    """The changes of all micro-batches, or those of one target (schema, table)."""
    rows = spark.read.schema(schema).parquet(path).drop("batch", BUCKET)
    if target is None:
        return rows
    return rows.filter((F.col("target_schema") == target[0]) & (F.col("target_table") == target[1]))


def collisions(plan: DataFrame, name: str = "sink_pipeline") -> DataFrame:
    """Pipeline names that more than one table would get."""
    return plan.groupBy(name).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
