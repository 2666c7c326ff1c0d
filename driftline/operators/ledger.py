"""Row counts kept with an expiry, and their comparison with the target.

A ledger row is (``database``, ``schema``, ``tbl``, ``row_count``, ``captured_at``, ``expires_at``);
``expires_at`` NULL never expires.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.names import COLLECTION, TABLE, named
from driftline.functions.times import moment, seconds
from driftline.operators.changes import latest_per_key
from driftline.operators.signals import remove

# Seconds a count stays valid, as written by the sync job and by default.
COUNT_TTL = 300
DEFAULT_TTL = 600

LEDGER = (*TABLE, "row_count", "captured_at", "expires_at")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (``name``, ``n``) per table, all counted in one job."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def row_counts_by_table(rows: DataFrame) -> DataFrame:
    """The same for a mixed relation that carries the table identity on every row."""
    return rows.groupBy(*TABLE).agg(F.count("*").alias("n"))


def ledger_put(
    ledger: DataFrame, counts: DataFrame, at: str | datetime | Column, ttl: int | Column = COUNT_TTL
) -> DataFrame:
    """The ledger after storing the positive counts (``row_count``), replacing older entries."""
    captured = moment(at, ledger, "captured_at")
    life = F.lit(ttl) if isinstance(ttl, int) else ttl
    fresh = (
        counts.filter(F.col("row_count") > 0)
        .withColumn("captured_at", captured)
        .withColumn("expires_at", F.when(life > 0, F.col("captured_at") + seconds(life)))
        .select(*LEDGER)
    )
    # One aggregation over both, so that the counts are computed once.
    both = ledger.select(*LEDGER, F.lit(0).alias("_put")).unionByName(fresh.withColumn("_put", F.lit(1)))
    return latest_per_key(both, TABLE, ["_put"]).select(*LEDGER)


def ledger_live(ledger: DataFrame, at: str | datetime | Column) -> DataFrame:
    """Entries that have not expired."""
    now = moment(at, ledger, "expires_at")
    return ledger.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def decode_value(text: Column) -> Column:
    """A stored value: JSON where it parses, the raw text where it does not."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def reconcile(ledger: DataFrame, target_counts: DataFrame, at: str | datetime | Column) -> DataFrame:
    """Add ``actual`` and ``status``: matched, pending, target_missing or expired."""
    now = moment(at, ledger, "expires_at")
    joined = ledger.join(target_counts.select(*TABLE, F.col("n").alias("actual")), list(TABLE), "left")
    status = (
        F.when(F.col("expires_at") <= now, "expired")
        .when(F.col("actual").isNull(), "target_missing")
        .when(F.col("actual") == F.col("row_count"), "matched")
        .otherwise("pending")
    )
    return joined.select(*TABLE, F.col("row_count").alias("expected"), "actual", status.alias("status"))


def settle(ledger: DataFrame, signals: DataFrame, result: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger and signal log without what belongs to matched tables."""
    done = result.filter(F.col("status") == "matched").select(*TABLE)
    open_counts = ledger.join(done, list(TABLE), "left_anti")
    return open_counts, remove(signals, done.withColumn("collection", named(COLLECTION)), on=("database", "collection"))
