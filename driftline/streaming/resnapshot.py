"""Reading tables again while their streams run.

A request names tables of a fleet. Their keys are cut into chunks and the chunks into windows. Before a window's rows
are read, the position of the change log is noted, its low mark; the position afterwards is its high mark. What was
changed up to the low mark is in the rows, so they outrank it; a change inside the window may be in them or not, so it
beats them, and comes with the stream. The rows enter the target at the low mark, and it does not matter which of the
two comes first.

Rows that the target holds of a requested table from before the first low mark, and that no window has brought again,
are gone from the source: their deletes are entered last.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.names import TABLE
from driftline.operators.snapshot import CHUNK_SIZE, snapshot_chunk, snapshot_plan
from driftline.streaming.apply import load_snapshot
from driftline.streaming.commits import attempt, commit, entries, exists
from driftline.streaming.target import KeyedTarget

# Chunks that are read in one window, and so by one job: at least so many, and more if that made too many windows.
CHUNKS_PER_WINDOW = 1_000
# A window may cost a pass over the source, so their number does not grow with it.
MOST_WINDOWS = 16

_PLANS = "folder string, low bigint, schema string, plan bigint"


class Window(NamedTuple):
    """A range of (table, key) from ``lo`` to ``hi``, read between two positions of the log."""

    number: int
    lo: Any
    hi: Any
    low: int
    high: int


def request_chunks(requests: DataFrame, rows: DataFrame, keys: list[str], chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """(table, ``chunk``, ``lo``, ``hi``, ``n``) for the requested tables of a fleet, all planned by one job.

    ``requests`` are rows as ``signals.snapshot_requests`` gives them, ``rows`` the source rows of the fleet.
    Chunks follow the order of (table, key) and are numbered through; none holds keys of two tables.
    """
    asked = requests.select(*TABLE).distinct()
    wanted = rows.select(*TABLE, *keys).join(asked, list(TABLE), "left_semi")
    plan = snapshot_plan(wanted, [*TABLE, *keys], chunk_size, within=TABLE)
    inner = [F.struct(*[F.col(f"{end}.{k}") for k in keys]).alias(end) for end in ("lo", "hi")]
    return plan.select(*[F.col(f"lo.{c}") for c in TABLE], "chunk", *inner, "n")


def resnapshot(
    requests: DataFrame,
    source: Callable[[], DataFrame],
    position: Callable[[], int],
    target: KeyedTarget,
    name: str,
    chunk_size: int = CHUNK_SIZE,
    chunks_per_window: int = CHUNKS_PER_WINDOW,
    window_read: Callable[[Window], None] | None = None,
) -> int:
    """Bring the requested tables into a target once more, and return the number of windows.

    ``source`` gives the fleet's rows as they are when it is called, ``position`` the last position of the change log,
    in the target's order. The target's key tells the table. Windows are batches of the origin ``name``: after a
    crash the call is repeated under the same name, keeps its plan, and skips the windows that are in. Streams may
    buffer and merge meanwhile. ``window_read`` is told each window.

    A window has ``chunks_per_window`` chunks, or as many more as keep the windows within ``MOST_WINDOWS``.
    """
    keys = [k for k in target.keys if k not in TABLE]
    if target.keys != [*TABLE, *keys] or len(target.order) != 1:
        raise ValueError("the target's key begins with the table's identity, and it has one order column")
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", name):
        raise ValueError(f"a name is an origin: {name!r}")
    spark = requests.sparkSession
    plan, low = _plan(requests, source, position, target, name, keys, chunk_size)
    key = F.struct(*[F.col(c) for c in TABLE], *[F.col(f"lo.{k}") for k in keys])
    last = F.struct(*[F.col(c) for c in TABLE], *[F.col(f"hi.{k}") for k in keys])
    chunks = (plan.agg(F.max("chunk")).first()[0] or 0) + 1
    width = max(chunks_per_window, -(-chunks // MOST_WINDOWS))
    number = F.floor(F.col("chunk") / width).alias("number")
    # One row per window.
    windows = plan.groupBy(number).agg(F.min(key).alias("lo"), F.max(last).alias("hi")).orderBy("number").collect()
    asked = plan.select(*TABLE).distinct()
    for w in windows:
        if target.holds(spark, w.number, name):
            continue
        at = position()
        rows = snapshot_chunk(source(), target.keys, tuple(w.lo), tuple(w.hi)).join(asked, list(TABLE), "left_semi")
        load_snapshot(rows, target, name, w.number, at)
        if window_read is not None:
            window_read(Window(w.number, tuple(w.lo), tuple(w.hi), at, position()))
    sweep = windows[-1].number + 1 if windows else 0
    if target.exists(spark) and not target.holds(spark, sweep, name):
        order = target.order[0]
        # tables without rows have no chunk, but are asked for all the same
        tables = requests.select(*TABLE).distinct()
        stale = target.read(spark).join(tables, list(TABLE), "left_semi").filter(F.col(order) < low)
        gone = stale.select(*target.keys, F.lit("d").alias("op"), F.lit(low).cast("bigint").alias(order))
        target.buffer(gone, sweep, name)
    return len(windows)


def _plan(
    requests: DataFrame, source: Callable[[], DataFrame], position: Callable[[], int], target: KeyedTarget, name: str, keys: list[str], chunk_size: int
) -> tuple[DataFrame, int]:
    """The chunks, as the first call under the name planned them, and the position of the log before it did."""
    spark = requests.sparkSession
    log = f"{target.path}/_snapshots/{name}"
    if not exists(spark, f"{log}/plan=0/entry.parquet"):
        low = position()
        plan = request_chunks(requests, source(), keys, chunk_size)
        folder = f"chunks-{attempt(0)}"
        plan.write.parquet(f"{log}/{folder}")
        commit(spark, log, "plan", 0, folder=[folder], low=[low], schema=[plan.schema.json()])
    return _planned(spark, log)


def _planned(spark: SparkSession, log: str) -> tuple[DataFrame, int]:
    entry = entries(spark, [f"{log}/plan=0"], _PLANS, log).first()
    return spark.read.parquet(f"{log}/{entry.folder}"), entry.low


def chunk_in_window(rows: DataFrame, changes: DataFrame, keys: list[str], low: int, high: int, order: str = "lsn") -> DataFrame:
    """Of the rows read between two marks, those of no key that was changed inside the window.

    For targets that take records as they come rather than by position: what is left held throughout the window,
    and may be put into the stream at its high mark.
    """
    inside = changes.filter((F.col(order) > low) & (F.col(order) <= high)).select(*keys).distinct()
    return rows.join(inside, keys, "left_anti")
