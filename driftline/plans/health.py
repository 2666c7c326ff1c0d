"""State of running pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.names import TABLE, TOPIC, named

# What a failed task's trace is searched for, in this order. The first word is
# case-sensitive, the others are compared in lower case.
WAREHOUSE = ("BigQuery",)
SCHEMA = ("schema", "avro")
QUOTA = ("quota", "rate")


def _any(text, words):
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def classify(status: DataFrame) -> DataFrame:
    """Failed tasks with their failure class. ``tasks`` is an array of (id, state, trace)."""
    failed = (
        status.select(*TABLE, F.explode(F.filter("tasks", lambda t: t["state"] == "FAILED")).alias("_t"))
        .select(*TABLE, F.col("_t.id").alias("task_id"), F.coalesce("_t.trace", F.lit("")).alias("trace"))
    )
    trace, lowered = F.col("trace"), F.lower("trace")
    kind = (
        F.when(_any(trace, WAREHOUSE), "bigquery")
        .when(_any(lowered, SCHEMA), "schema")
        .when(_any(lowered, QUOTA), "quota")
        .otherwise("general")
    )
    return failed.withColumn("failure", kind)


def status_rollup(status: DataFrame) -> DataFrame:
    """Connector state and task counts per table; a missing state reads UNKNOWN."""
    unknown = F.lit("UNKNOWN")
    tasks = F.coalesce("tasks", F.from_json(F.lit("[]"), status.schema["tasks"].dataType))
    states = F.transform(tasks, lambda t: F.coalesce(t["state"], unknown))
    count = lambda state: F.size(F.filter("_states", lambda s: s == state)).cast("bigint")
    return status.withColumn("_states", states).select(
        *TABLE,
        F.coalesce("connector.state", unknown).alias("state"),
        F.size("_states").cast("bigint").alias("tasks"),
        count("RUNNING").alias("running"),
        count("FAILED").alias("failed"),
        count("UNKNOWN").alias("unknown"),
    )


def health_plan(tables: DataFrame, status: DataFrame, topics: DataFrame) -> DataFrame:
    """``action`` per table: create what is missing, restart what does not run, flag a missing topic.

    ``status`` has one row per table with ``state``; ``topics`` lists topic names. A table without a row has no pipeline;
    a pipeline without a state is one that does not run, its state UNKNOWN.
    """
    listed = topics.select("topic").distinct().withColumn("_topic", F.lit(True))
    joined = (
        tables.join(status.select(*TABLE, F.coalesce("state", F.lit("UNKNOWN")).alias("state")), list(TABLE), "left")
        .withColumn("topic", named(TOPIC))
        .join(listed, "topic", "left")
    )
    action = (
        F.when(F.col("state").isNull(), "create")
        .when(F.col("state") != "RUNNING", "restart")
        .otherwise("ok")
    )
    return joined.select(*TABLE, "state", action.alias("action"), F.col("_topic").isNull().alias("topic_missing"))
