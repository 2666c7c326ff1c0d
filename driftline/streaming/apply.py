"""Streams of changes into a target."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from threading import Lock, Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from driftline.functions.lattice import present
from driftline.operators.snapshot import BEFORE_STREAM
from driftline.plans.routes import route, write_routed
from driftline.streaming.quarantine import CORRUPT, write_quarantined
from driftline.streaming.target import KeyedTarget

# Fixed value: seconds between merges.
MERGE_INTERVAL = "60 seconds"
# Folders of a micro-batch of a routed stream.
ROUTE_BUCKETS = 16


def stream_apply(
    changes: DataFrame,
    target: KeyedTarget,
    every: str | None = MERGE_INTERVAL,
    merge_records: int = 0,
    compact_every: int = 20,
    prepare: Callable[[DataFrame, int], DataFrame] | None = None,
    origin: str = "stream",
    merge_batches: int = 60,
    merge_seconds: float | None = None,
) -> StreamingQuery:
    """Buffer each micro-batch and merge once ``merge_records`` changes, or ``merge_batches`` batches, have gathered.

    A merge reads and writes every bucket it touches, which for changes spread over all keys is the
    whole table: let ``merge_records`` grow with it. ``merge_batches`` bounds what readers apply, also where few
    changes come. ``merge_seconds`` bounds how long changes stay buffered, whether more come or the stream falls silent:
    then Spark's idle events, one per ``spark.sql.streaming.noDataProgressEventInterval``, bring the merge about. Every
    ``compact_every``-th batch compacts as well.

    ``every`` is the interval of the micro-batches; None works off what is there and stops. The target
    is created by its first batch, with that batch's schema. Streams and snapshots that feed one target differ in
    ``origin``: batches are numbered within theirs. ``prepare`` runs on the micro-batch
    and its id, for what a stream's fixed schema cannot express. A failed micro-batch is repeated from the checkpoint
    under its old id, which the target recognises.
    """
    waits = _Waits(merge_seconds)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        status = target.buffer(prepare(batch, batch_id) if prepare else batch, batch_id, origin)
        waits.begin()
        if status.records >= max(merge_records, 1) or len(status.pending) >= merge_batches or waits.over():
            with waits.merging:
                target.merge(spark, compact=(batch_id + 1) % compact_every == 0, status=status)
                waits.end()

    query = _start(changes, apply, f"{target.path}/_checkpoint/{origin}", every)
    if merge_seconds is not None:
        changes.sparkSession.streams.addListener(_Quiet(changes.sparkSession, query.id, target, waits))
    return query


class _Waits:
    """Since when the changes of a stream wait to be merged."""

    def __init__(self, most: float | None):
        self.most = most
        self.since: float | None = None
        self.merging = Lock()

    def begin(self) -> None:
        if self.since is None:
            self.since = time.monotonic()

    def over(self) -> bool:
        since = self.since
        return self.most is not None and since is not None and time.monotonic() - since >= self.most

    def end(self) -> None:
        self.since = None


class _Quiet(StreamingQueryListener):
    """Merges what a silent stream has left buffered for too long.

    Events come on a thread that all queries share, so the merge has a thread of its own; there is one at a time.
    """

    def __init__(self, spark: SparkSession, query_id: str, target: KeyedTarget, waits: _Waits):
        self.spark, self.query_id, self.target, self.waits = spark, query_id, target, waits

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        # A trigger that finds nothing new may report progress rather than idleness.
        self._look(event.progress.id)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._look(event.id)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) == str(self.query_id):
            Thread(target=self.spark.streams.removeListener, args=(self,), daemon=True).start()

    def _look(self, query_id) -> None:
        if str(query_id) == str(self.query_id) and self.waits.over() and self.waits.merging.acquire(blocking=False):
            Thread(target=self._merge, daemon=True).start()

    def _merge(self) -> None:
        try:
            if self.waits.over():
                self.target.merge(self.spark)
                self.waits.end()
        finally:
            self.waits.merging.release()


def load_snapshot(rows: DataFrame, target: KeyedTarget, origin: str, chunk: int = 0, at: int = BEFORE_STREAM) -> None:
    """Buffer the rows of a snapshot, or of one of its chunks, into a target that streams may feed meanwhile.

    The rows rank at ``at`` in the target's order: by default below every streamed change, so that neither an
    update nor a delete that came in before is undone. A later snapshot, read to repair the table, names the position
    of the log at which it was read. Each snapshot has an ``origin`` of its own; its chunks may be loaded
    in any order, and one that is loaded again is skipped.
    """
    if len(target.order) != 1:
        raise ValueError("a snapshot needs a target with a single order column")
    records = rows.withColumns({"op": F.lit("r"), target.order[0]: F.lit(at).cast("bigint")})
    target.buffer(records, chunk, origin)


def stream_route(
    changes: DataFrame, plan: DataFrame, path: str, every: str | None = MERGE_INTERVAL, buckets: int | None = ROUTE_BUCKETS
) -> StreamingQuery:
    """Split a mixed stream by target: each micro-batch is written once, in ``buckets`` folders at most, or with None
    in one folder per target."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_routed(route(batch, plan), path, batch_id, buckets)

    return _start(changes, write, f"{path}/_checkpoint", every)


def _start(
    changes: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None
) -> StreamingQuery:
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def tolerate(schema: T.StructType, path: str, column: str = "value") -> Callable[[DataFrame, int], DataFrame]:
    """A ``prepare`` that parses JSON text, keeps what does not parse under ``path``, and goes on."""

    def prepare(batch: DataFrame, batch_id: int) -> DataFrame:
        written = write_quarantined(batch, batch_id, schema, path, column)
        return written.filter(F.col("side") == "good").drop("side", CORRUPT)

    return prepare


def expand_json(batch: DataFrame, batch_id: int, column: str = "after") -> DataFrame:
    """A ``prepare`` that replaces a row image kept as JSON text by its fields, as this batch has them.

    The fields and their types are found in one aggregation over the batch; fields of mixed types
    become text, and fields that are NULL throughout are absent.
    """
    image = F.try_parse_json(column)
    found = batch.select(F.schema_of_variant_agg(image)).first()[0]
    rest = [c for c in batch.columns if c != column]
    if not found or not found.startswith("OBJECT<") or found == "OBJECT<>":
        return batch.select(*rest)
    # Names that are not plain words stand in backquotes, and are left as they are.
    pieces = re.split(r"(`(?:[^`]|``)*`)", found)
    pieces[::2] = [re.sub(r"\bVARIANT\b(?!:)", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", x)) for x in pieces[::2]]
    kind = present(T.DataType.fromDDL("".join(pieces)))
    if not kind.fields:
        return batch.select(*rest)
    return batch.withColumn("_image", F.from_json(column, kind)).select(*rest, "_image.*")
