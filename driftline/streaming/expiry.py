"""Entries that run out: a stream of the deletes that their time to live brings about.

Spark keeps the puts of the keys as state, those of a group of keys together, and wakes a group by a timer when an end comes,
so a micro-batch costs as much as its puts and the ends that come in it, however many groups there are. The clock is the watermark of the puts, in
whole milliseconds. It gates nothing: the column it is taken from does not reach the stateful operator, which thus
sees every put, however late.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from driftline.streaming.target import KeyedTarget

PUTS = "puts"
#: The order of an entry's records: the moment they speak of, then how often that moment has been spoken of.
ORDER = ("lsn", "turn")
#: Groups of keys whose entries share a value of the state and a timer.
GROUPS = 1 << 14
_STATES = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_expirations(
    puts: DataFrame,
    target: KeyedTarget,
    path: str,
    at: str,
    ttl: Column,
    every: str | None = None,
    merge_batches: int = 20,
    late: int | None = None,
    groups: int = GROUPS,
) -> StreamingQuery:
    """Writes under ``path`` one delete for each entry whose time has run out, and a correction where a put that
    comes late takes it back; ``expirations`` reads what stands.

    The last put of a key decides, whatever order they arrive in: it replaces the time to live of the one before, and
    puts without one, or with none above zero, live on. Of puts at the same time the one that ends last counts, and
    any end goes before none. An entry runs out where its time ends before the next put of its key and
    lies no later than the latest put of all, which is the clock; a put at the very end of the time comes in time.

    ``target`` keeps the entries by key, in the order ``ORDER``: the time in microseconds, and a turn that tells a
    correction from what it corrects. ``ttl`` is in seconds. ``late`` bounds the state of a key: of the puts that lie more
    seconds behind the clock only the last is kept, so that one which comes later than that and lies before it
    is neither an end nor the end of another. The entries are the same for any bound; without one, so is every delete.

    Keys fall into ``groups`` by hash, fixed for the life of the stream, whose entries are read and written together.
    Choose it so that a group holds some tens of keys: then a put costs no more than it would alone.

    A batch is written once and then kept in the target; a batch repeated after a crash comes from the same state.
    """
    if tuple(target.order) != ORDER:
        raise ValueError(f"the target of entries is ordered by {ORDER}")
    spark = puts.sparkSession
    keys = target.keys
    lsn = F.unix_micros(F.col(at).cast("timestamp"))
    end = F.when(ttl > 0, lsn + ttl.cast("bigint") * 1_000_000)
    clocked = puts.withColumn("_clock", F.col(at).cast("timestamp")).withWatermark("_clock", "0 seconds")
    rows = clocked.select(*keys, lsn.alias("starts"), end.alias("ends"))
    kinds = [rows.schema[k] for k in keys]
    out = T.StructType([*kinds, *T.StructType.fromDDL("op string, lsn bigint, turn bigint, ends bigint, expired boolean").fields])
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups))).groupBy("_group")
    records = grouped.transformWithState(_entries(keys, late), out, "append", "eventTime")

    def apply(batch: DataFrame, batch_id: int) -> None:
        where = f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(where)
        written = batch.sparkSession.read.schema(out).parquet(where)
        status = target.buffer(written.drop("expired"), batch_id, PUTS)
        if len(status.pending) >= merge_batches:
            target.merge(batch.sparkSession, status=status)

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    writer = records.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", f"{target.path}/_checkpoint/{PUTS}")
    # a query takes the setting of the moment it is started
    before = spark.conf.get(_STATES)
    spark.conf.set(_STATES, _ROCKS)
    try:
        return writer.trigger(**trigger).start()
    finally:
        spark.conf.set(_STATES, before)


def expirations(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The deletes (keys, ``op``, ``lsn``, ``ts``) that stand: the last word on each end."""
    said = spark.read.parquet(path).filter(F.col("expired").isNotNull())
    last = said.groupBy(*keys, "lsn").agg(F.max_by("expired", "turn").alias("_expired"))
    return last.filter("_expired").select(*keys, F.lit("d").alias("op"), "lsn", F.timestamp_micros("lsn").alias("ts"))


def _entries(names: Sequence[str], late: int | None) -> StatefulProcessor:
    """The state of a group. Defined within a function, so that it travels to the tasks by itself."""
    import pickle
    from bisect import bisect_left, bisect_right
    from operator import attrgetter

    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class Entry:
        """``starts`` and ``ends`` are the puts of ``key`` in order, ``settled`` the first of them if older ones are forgotten.
        ``said`` are the ends on which something was written, with the turn of the last word and what it was: whether
        the entry expired there, and whether it was alive. ``due`` is the first end that is still to come."""

        def __init__(self, key, settled=None, starts=(), ends=(), said=(), due=None):
            self.key, self.settled, self.due = key, settled, due
            self.starts, self.ends, self.said = list(starts), list(ends), dict(said)

        def state(self):
            return self.key, self.settled, self.starts, self.ends, self.said, self.due

        def take(self, puts):
            """The puts that are news."""
            fresh = []
            starts, ends = self.starts, self.ends
            for start, end in puts:
                if self.settled is not None and start < self.settled:
                    continue
                i = bisect_left(starts, start)
                if i < len(starts) and starts[i] == start:
                    if end is None or (ends[i] is not None and ends[i] >= end):
                        continue
                    ends[i] = end
                else:
                    starts.insert(i, start)
                    ends.insert(i, end)
                fresh.append((start, end))
            return fresh

        def tell(self, now):
            """(op, lsn, turn, ends, expired) of what has changed at any place."""
            starts, ends, said = self.starts, self.ends, self.said
            self.due = None
            for i, end in enumerate(ends):
                if end is not None and (i + 1 == len(starts) or end < starts[i + 1]):
                    if end > now * 1000:
                        self.due = end if self.due is None else min(self.due, end)
                    elif end not in said:
                        said[end] = (0, False, None)
            for place in sorted(said):
                turn, was, alive = said[place]
                i = bisect_right(starts, place) - 1
                if i < 0:  # its put is settled, and so is the place
                    continue
                end = ends[i]
                is_end = end == place
                lives = end is None or end > place
                if turn == 0 or (is_end, lives) != (was, alive):
                    said[place] = (turn + 1, is_end, lives)
                    yield "c" if lives else "d", place, turn + 1, end if lives else None, is_end
            if late is not None:
                old = bisect_right(starts, now * 1000 - late * 1_000_000) - 1
                if old > 0:
                    del starts[:old], ends[:old]
                    self.settled = starts[0]
                    for place in [p for p in said if p < starts[0]]:
                        del said[place]

    class Entries(StatefulProcessor):
        """The entries of a group are one value: a call of the state store costs far more than some tens of entries."""

        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getValueState("entries", "entries binary")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802
            entries = self._load()
            puts = {}
            of = attrgetter(*names, "starts", "ends")
            for r in rows:
                *own, start, end = of(r)
                puts.setdefault(repr(own), (own, []))[1].append((start, end))
            for name, (own, found) in puts.items():
                if name not in entries:
                    entries[name] = Entry(own)
                for start, end in entries[name].take(found):
                    yield out(*own, "c", start, 0, end, None)
            yield from self._tell(entries, puts, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
            yield from self._tell(self._load(), (), timerValues.getCurrentWatermarkInMs())

        def _load(self):
            held = self.held.get()
            return {} if held is None else {name: Entry(*x) for name, x in pickle.loads(bytes(held[0])).items()}

        def _tell(self, entries, changed, now):
            """Writes what has changed in entries with news or with an end that has come, and keeps the state."""
            for name, entry in entries.items():
                if name in changed or (entry.due is not None and entry.due <= now * 1000):
                    for said in entry.tell(now):
                        yield out(*entry.key, *said)
            coming = min((e.due for e in entries.values() if e.due is not None), default=None)
            if coming is not None:
                # One timer wakes the group, at the first end that comes, and then sets the next: ends that the clock
                # passes at once are told at once. A timer is due at a time or just after it: one more is set if it comes early.
                due = -(-coming // 1000)
                self.handle.registerTimer(due - 1 if now < due - 1 else due)
            self.held.update((pickle.dumps({name: e.state() for name, e in entries.items()}),))

        def close(self) -> None:
            pass

    out = Row(*names, "op", "lsn", "turn", "ends", "expired")
    return Entries()
