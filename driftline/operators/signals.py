"""The log of control signals: (``id``, ``type``, ``data`` as JSON text, ``created_at``).

A log that covers several databases also carries ``database``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.names import COLLECTION, SIGNAL_ID, TABLE, named
from driftline.functions.times import epoch_seconds, moment, seconds

# Signal types and the field that names the tables of a snapshot signal.
SNAPSHOT = "execute-snapshot"
SCHEMA_CHANGE = "schema-change"
COLLECTIONS = "data-collections"

RETENTION_HOURS = 24


def signals_for(tables: DataFrame, signal_type: str | Column = SNAPSHOT, at: str = "created_at") -> DataFrame:
    """One signal per table row; ``at`` is the column holding the time it is raised."""
    kind = F.lit(signal_type) if isinstance(signal_type, str) else signal_type
    staged = tables.withColumn("type", kind)
    plain = named(SIGNAL_ID)
    stamped = F.concat(plain, F.lit("_"), epoch_seconds(tables, at).cast("string"))
    snapshot = F.to_json(
        F.struct(F.array(named(COLLECTION)).alias(COLLECTIONS), F.lit("incremental").alias("type"))
    )
    change = F.to_json(F.struct(F.col("database")))
    return staged.select(
        "database",
        F.when(F.col("type") == SNAPSHOT, stamped).otherwise(plain).alias("id"),
        "type",
        F.when(F.col("type") == SNAPSHOT, snapshot)
        .when(F.col("type") == SCHEMA_CHANGE, change)
        .otherwise("{}")
        .alias("data"),
        F.col(at).alias("created_at"),
    )


def append(log: DataFrame, signals: DataFrame) -> DataFrame:
    """The log with new signals; an id that is already there is kept as it is, and of several new ones the earliest."""
    signal = _shared(log, signals, "id")
    rest = [c for c in log.columns if c not in signal]
    first = F.min_by(F.struct(*rest), F.struct("created_at", *[c for c in rest if c != "created_at"]))
    new = signals.groupBy(*signal).agg(first.alias("_first")).select(*signal, "_first.*")
    return log.unionByName(new.join(log.select(*signal).distinct(), signal, "left_anti").select(*log.columns))


def _shared(log: DataFrame, other: DataFrame, *names: str) -> list[str]:
    """The names, and the database before them where both sides tell it: tables of several may have the same name."""
    return [*(["database"] if "database" in log.columns and "database" in other.columns else []), *names]


def retain(log: DataFrame, at: str | datetime | Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Signals no older than the retention."""
    return log.filter(F.col("created_at") >= moment(at, log, "created_at") - seconds(hours * 3600))


def active(log: DataFrame) -> DataFrame:
    """All signals, newest first."""
    return log.select("id", "type", "data", "created_at").orderBy(F.desc("created_at"), "id")


def exploded(log: DataFrame) -> DataFrame:
    """One row per signal and collection it names."""
    names = F.from_json(F.get_json_object("data", f"$.{COLLECTIONS}"), "array<string>")
    return log.withColumn("collection", F.explode(names))


def collections(log: DataFrame) -> DataFrame:
    """Distinct collections named in the log, by database where it tells it."""
    return exploded(log).select(*_shared(log, log, "collection")).distinct()


def has_signal(tables: DataFrame, log: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Add ``signals``, the number naming the table, and ``has_signal``.

    The log is counted per collection before the join, so a table named by a third of it is no hot key.
    """
    on = on or _shared(log, tables, "collection")
    counts = exploded(log).groupBy(*on).agg(F.count_distinct("id").alias("signals"))
    joined = tables.withColumn("collection", named(COLLECTION)).join(counts, list(on), "left")
    n = F.coalesce("signals", F.lit(0))
    return joined.select(*tables.columns, n.alias("signals"), (n > 0).alias("has_signal"))


def signal_ids(tables: DataFrame, log: DataFrame) -> DataFrame:
    """Add ``listed``: whether the log holds exactly the unstamped id of the table, for its database if it tells it."""
    on = _shared(log, tables, "id")
    ids = log.select(*on).distinct().withColumn("_listed", F.lit(True))
    joined = tables.withColumn("id", named(SIGNAL_ID)).join(ids, on, "left")
    return joined.select(*tables.columns, F.coalesce("_listed", F.lit(False)).alias("listed"))


def remove(log: DataFrame, tables: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """The log without signals that name one of the tables (``collection``), of their database if both sides tell it."""
    on = on or _shared(log, tables, "collection")
    signal = [c for c in ("database", "id") if c in log.columns]
    doomed = exploded(log).join(tables.select(*on).distinct(), list(on), "left_semi").select(*signal).distinct()
    return log.join(doomed, signal, "left_anti").select(*log.columns)


def expire(log: DataFrame, at: str | datetime | Column, ttl: str = "ttl_seconds") -> DataFrame:
    """Signals whose own time to live has not run out; without one they stay."""
    deadline = F.col("created_at") + seconds(F.col(ttl))
    return log.filter(F.col(ttl).isNull() | (F.col(ttl) <= 0) | (deadline > moment(at, log, "created_at")))


def snapshot_requests(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables of the catalog that a snapshot signal asks to read again, with the latest request."""
    asked = (
        exploded(log.filter(F.col("type") == SNAPSHOT))
        .filter(F.get_json_object("data", "$.type") == "incremental")
        .groupBy("database", "collection")
        .agg(F.max("created_at").alias("requested_at"), F.count_distinct("id").alias("requests"))
    )
    named_tables = catalog.withColumn("collection", named(COLLECTION))
    return named_tables.join(asked, ["database", "collection"]).select(*TABLE, "requested_at", "requests")
