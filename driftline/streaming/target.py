"""A Parquet table that takes changes by key.

Changes are buffered per batch and folded into the base from time to time:

``delta/origin=<o>/batch=<n>-<a>``            one record per key of batch ``n`` of an origin
``base/version=<v>-<a>/_bucket=<b>``          latest record per key, tombstones included
``_batches/epoch=<v>/origin=<o>/batch=<n>``   a batch that counts, its folder, records and schema
``_manifests/version=<v>``                    for every bucket the folder that holds it

A merge reads and rewrites only the buckets that the buffered changes touch. Readers see the base with
the buffered changes applied, so buffering delays nothing. Both steps write files first, every attempt ``a`` into a
folder of its own, and commit them afterwards. Of merges that run at the same time the first to commit wins, and the
others start again from what it left, so that any number of streams may feed and merge one table.

A batch is entered under the version that its writer knows, its epoch. If a version came out meanwhile, the merge
behind it may not have seen the entry, and the writer enters the batch again. Hence a batch that counts and is not
merged stands in the current epoch or the one before, and only these are listed, however long the table lives.

Every stream and every snapshot that feeds the table is an origin with batch numbers of its own. Which batches are
merged is kept per origin, as ranges of numbers: the chunks of a snapshot may come in any order. Which record of a key
wins is decided by the order columns alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.lattice import merged_schema, relax
from driftline.operators.changes import apply_changes, drop_deleted, kept_and_fresh, latest_per_key
from driftline.operators.schema import conform
from driftline.streaming.commits import attempt, commit, committed, entries, exists, latest

_BATCHES = "records bigint, key_bytes bigint, buckets array<bigint>, schema string, folder string, epoch bigint, origin string, batch bigint"
_MANIFESTS = "bucket bigint, data string, through string, schema string, version bigint"


# Number of buffered changes, and text length of their keys and order, up to which these are broadcast.
BROADCAST_RECORDS = 500_000
BROADCAST_BYTES = 64 << 20

_BUCKET = "_bucket"
_TABLE = -1  # manifest row of the table as a whole, which may have no bucket left


class Manifest(NamedTuple):
    """``buckets`` maps a bucket to the folder that holds it and the schema of its files, ``through`` an origin
    to the ranges (first, last) of its merged batches."""

    version: int
    through: dict[str, list[tuple[int, int]]]
    schema: str
    buckets: dict[int, tuple[str, str]]

    def merged(self, origin: str, batch: int) -> bool:
        return any(first <= batch <= last for first, last in self.through.get(origin, []))


class Batch(NamedTuple):
    """A buffered batch, with the buckets it touches."""

    origin: str
    batch: int
    records: int
    key_bytes: int
    buckets: list[int]
    schema: str
    folder: str


class Status(NamedTuple):
    """What counts at a moment: the base, and the batches not merged yet."""

    manifest: Manifest
    pending: list[Batch]

    def holds(self, origin: str, batch_id: int) -> bool:
        """Whether a batch is merged or buffered."""
        return self.manifest.merged(origin, batch_id) or (origin, batch_id) in {(b.origin, b.batch) for b in self.pending}

    @property
    def records(self) -> int:
        return sum(b.records for b in self.pending)


class KeyedTarget:
    """``buckets`` bounds the rewrite of a merge and is fixed for the life of the table.

    Choose it so that a bucket holds some gigabytes: thousands for a table of terabytes. ``count_by`` names columns of
    the key, the identity of a fleet's tables for instance, by which every merge counts the rows of what it writes.
    """

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str] = ("lsn",), *, buckets: int, count_by: Sequence[str] = ()):
        if set(count_by) - set(keys):
            raise ValueError("rows are counted by columns of the key")
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.order = list(order)
        self.buckets = buckets
        self.count_by = list(count_by)
        self._last = Manifest(0, {}, "", {})

    # -- writing ---------------------------------------------------------------------------------

    def buffer(self, changes: DataFrame, batch_id: int, origin: str = "stream") -> Status:
        """Keep the last change per key of one batch; a batch that its origin has already brought is skipped.

        The numbers of an origin start at 0 and may come in any order.
        """
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", origin):
            raise ValueError(f"an origin names a folder and starts with a letter: {origin!r}")
        spark = changes.sparkSession
        status = self.status(spark)
        if status.holds(origin, batch_id):
            return status
        newest = latest_per_key(self._same_keys(changes, status), self.keys, self.order)
        newest = conform(newest, relax(newest.schema))
        folder = f"delta/origin={origin}/batch={attempt(batch_id)}"
        newest.write.parquet(f"{self.path}/{folder}")
        written = spark.read.schema(newest.schema).parquet(f"{self.path}/{folder}")
        width = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in [*self.keys, *self.order]), F.lit(0))
        # At most one element per bucket.
        touched = F.sort_array(F.collect_set(self._bucket()))
        found = written.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0)), touched).first()
        return self._enter(spark, status, Batch(origin, batch_id, *found, newest.schema.json(), folder))

    def _enter(self, spark: SparkSession, status: Status, batch: Batch) -> Status:
        """Commit a batch, under as many versions as come out meanwhile."""
        while not status.holds(batch.origin, batch.batch):
            version = status.manifest.version
            first = commit(
                spark,
                f"{self.path}/_batches/epoch={version}/origin={batch.origin}",
                "batch",
                batch.batch,
                records=[batch.records],
                key_bytes=[batch.key_bytes],
                buckets=pa.array([batch.buckets], pa.list_(pa.int64())),
                schema=[batch.schema],
                folder=[batch.folder],
            )
            if first and not exists(spark, self._version(version + 1)):
                return Status(status.manifest, sorted([*status.pending, batch]))
            status = self.status(spark)
        return status

    def merge(
        self,
        spark: SparkSession,
        forget_below: Column | None = None,
        compact: bool = False,
        status: Status | None = None,
    ) -> None:
        """Fold the buffered batches into the buckets they touch.

        Few changes leave the kept records in the tasks that read them, so a merge adds a file to each
        bucket it touches; ``compact`` shuffles the touched buckets once and gives each one file, or
        several if it is large. Tombstones stay, so that a late older change cannot revive a deleted
        key; ``forget_below`` is a condition under which they may go, for instance on ``ts``.
        ``status`` spares reading the commits again. A merge that another writer overtakes starts again.
        """
        while not self._merge(spark, forget_below, compact, status or self.status(spark)):
            status = None

    def _merge(self, spark: SparkSession, forget_below: Column | None, compact: bool, status: Status) -> bool:
        manifest, pending = status
        changes = self._changes(spark, pending)
        if changes is None:
            return True
        touched = sorted({b for batch in pending for b in batch.buckets})
        state = self._base(spark, {b: manifest.buckets[b] for b in touched if b in manifest.buckets})
        few = _few(pending)
        kept, fresh = self._apply(state, changes, few)
        if kept is None or compact:
            merged = self._balanced(fresh if kept is None else kept.unionByName(fresh))
        else:
            merged = kept.withColumn(_BUCKET, self._bucket()).unionByName(self._balanced(fresh))
        if forget_below is not None:
            merged = merged.filter(~((F.col("op") == "d") & forget_below))
        merged = conform(merged, relax(merged.schema))
        version = manifest.version + 1
        data = attempt(version)
        merged.write.partitionBy(_BUCKET).parquet(f"{self.path}/base/version={data}")
        schema = merged.drop(_BUCKET).schema.json()
        buckets = {**manifest.buckets, **dict.fromkeys(touched, (data, schema))}
        if forget_below is not None:
            left = spark.read.schema(f"{_BUCKET} bigint").parquet(f"{self.path}/base/version={data}")
            for gone in set(touched) - {r[0] for r in left.distinct().collect()}:
                del buckets[gone]
        if self.count_by:
            written = spark.read.schema(merged.schema).parquet(f"{self.path}/base/version={data}")
            alive = drop_deleted(written.select(_BUCKET, *self.count_by, "op"))
            counts = alive.groupBy(_BUCKET, *self.count_by).agg(F.count("*").alias("n"))
            counts.write.parquet(f"{self.path}/counts/version={data}")
        rows = {_TABLE: (data, schema), **buckets}
        through = dict(manifest.through)
        for origin in {b.origin for b in pending}:
            through[origin] = _ranges([*through.get(origin, []), *((b.batch, b.batch) for b in pending if b.origin == origin)])
        return commit(
            spark,
            f"{self.path}/_manifests",
            "version",
            version,
            bucket=list(rows),
            data=[data for data, _ in rows.values()],
            through=[json.dumps(through) if b == _TABLE else None for b in rows],
            schema=[kind for _, kind in rows.values()],
        )

    # -- reading ---------------------------------------------------------------------------------

    def status(self, spark: SparkSession) -> Status:
        manifest = self._manifest(spark)
        log = f"{self.path}/_batches"
        found = entries(spark, [f"{log}/epoch={v}" for v in (manifest.version - 1, manifest.version) if v >= 0], _BATCHES, log)
        # The merge cadence bounds the number of batches.
        rows = found.orderBy("epoch").select(*Batch._fields).collect() if found is not None else []
        # One that was entered twice counts once.
        batches = {(b.origin, b.batch): b for b in (Batch(*r) for r in rows) if not manifest.merged(b.origin, b.batch)}
        return Status(manifest, sorted(batches.values()))

    def holds(self, spark: SparkSession, batch_id: int, origin: str = "stream") -> bool:
        """Whether a batch of an origin is in."""
        return self.status(spark).holds(origin, batch_id)

    def exists(self, spark: SparkSession) -> bool:
        """Whether anything is committed."""
        status = self.status(spark)
        return bool(status.pending) or status.manifest.version > 0

    def records(self, spark: SparkSession) -> DataFrame:
        """Latest record of every key, tombstones included."""
        manifest, pending = self.status(spark)
        changes = self._changes(spark, pending)
        base = self._base(spark, manifest.buckets)
        if changes is not None:
            kept, fresh = self._apply(base, changes, _few(pending))
            return fresh if kept is None else kept.unionByName(fresh)
        if base is not None:
            return base
        if manifest.version == 0:
            raise ValueError(f"nothing committed under {self.path}")
        return spark.createDataFrame([], T.StructType.fromJson(json.loads(manifest.schema)))

    def read(self, spark: SparkSession) -> DataFrame:
        """The table: latest record of every key that is not deleted."""
        return drop_deleted(self.records(spark))

    def counts(self, spark: SparkSession) -> DataFrame:
        """(``count_by``, ``n``): the rows that are not deleted, as of the last merge, from the counts that every merge
        left of the buckets it wrote. No row of the table is read."""
        manifest = self._manifest(spark)
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(manifest.schema)).fields} if manifest.schema else {}
        own = [T.StructField(c, kinds.get(c, T.StringType())) for c in self.count_by]
        schema = T.StructType([T.StructField(_BUCKET, T.LongType()), *own, T.StructField("n", T.LongType()), T.StructField("version", T.StringType())])
        # Of a version count the buckets that no later one has written again.
        current = spark.createDataFrame([(b, data) for b, (data, _) in manifest.buckets.items()], f"{_BUCKET} bigint, version string")
        folders = {f"{self.path}/counts/version={data}" for data, _ in manifest.buckets.values()}
        counted = entries(spark, sorted(folders), schema, f"{self.path}/counts")
        if counted is None:
            counted = spark.createDataFrame([], schema)
        return counted.join(F.broadcast(current), [_BUCKET, "version"]).groupBy(*self.count_by).agg(F.sum("n").alias("n"))

    def obsolete(self, spark: SparkSession) -> DataFrame:
        """Folders (``path``) that no new reader needs, for whatever cleans up the storage: as a relation, since their
        number grows for as long as nothing does."""
        manifest, pending = self.status(spark)
        log = committed(spark, f"{self.path}/_manifests", _MANIFESTS)
        batches = committed(spark, f"{self.path}/_batches", _BATCHES)
        if log is None or batches is None:
            return spark.createDataFrame([], "path string")
        # entries of epochs that are no longer listed, and the folders of batches that do not wait to be merged
        waiting = spark.createDataFrame([(b.folder,) for b in pending], "folder string")
        done = batches.select("folder").distinct().join(waiting, "folder", "left_anti")
        closed = batches.filter(F.col("epoch") < manifest.version - 1).select("epoch").distinct()
        current = spark.createDataFrame([(b, data) for b, (data, _) in manifest.buckets.items()], "bucket bigint, data string")
        named = log.filter(F.col("bucket") != _TABLE).select("bucket", "data").distinct()
        gone = named.join(current, ["bucket", "data"], "left_anti")
        old = log.filter(F.col("version") < manifest.version).select("version").distinct()
        folders = [
            gone.select(F.format_string(f"%s/base/version=%s/{_BUCKET}=%d", F.lit(self.path), "data", "bucket")),
            old.select(F.format_string("%s/_manifests/version=%d", F.lit(self.path), "version")),
            done.select(F.format_string("%s/%s", F.lit(self.path), "folder")),
            closed.select(F.format_string("%s/_batches/epoch=%d", F.lit(self.path), "epoch")),
        ]
        return reduce(DataFrame.union, folders).toDF("path")

    # -- parts -----------------------------------------------------------------------------------

    def _same_keys(self, changes: DataFrame, status: Status) -> DataFrame:
        """The changes with the key types that the first batch gave the table.

        A key that widens would be found in another bucket under another text. Keys that do not fit, and
        would come back changed from a cast there and back, are an error.
        """
        first = status.manifest.schema or (status.pending[0].schema if status.pending else None)
        if first is None:
            return changes
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(first)).fields}
        for k in self.keys:
            given = changes.schema[k].dataType
            if given != kinds[k]:
                cast = F.col(k).try_cast(kinds[k])
                lost = F.col(k).isNotNull() & ~F.coalesce(cast.try_cast(given) == F.col(k), F.lit(False))
                message = F.concat(F.lit(f"key {k} does not fit {kinds[k].simpleString()}: "), F.col(k).cast("string"))
                changes = changes.withColumn(k, F.when(lost, F.raise_error(message)).otherwise(cast))
        return changes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets))

    def _balanced(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, self._bucket()).hint("rebalance", F.col(_BUCKET))

    def _apply(
        self, state: DataFrame | None, changes: DataFrame, few: bool
    ) -> tuple[DataFrame | None, DataFrame]:
        if state is None:
            return None, latest_per_key(changes, self.keys, self.order)
        schema = merged_schema(state.schema, changes.schema)
        state, changes = conform(state, schema), conform(changes, schema)
        if few:
            return kept_and_fresh(state, changes, self.keys, self.order)
        return None, apply_changes(state, changes, self.keys, self.order)

    def _version(self, version: int) -> str:
        return f"{self.path}/_manifests/version={version}/entry.parquet"

    def _manifest(self, spark: SparkSession) -> Manifest:
        """The current manifest: as many rows as the table has buckets. The last one read is kept."""
        log = f"{self.path}/_manifests"
        version = latest(spark, log, "version", self._last.version)
        if version > self._last.version:
            found = entries(spark, [f"{log}/version={version}"], _MANIFESTS, log)
            rows = sorted(found.collect(), key=lambda r: (r.data, r.bucket))
            buckets = {r.bucket: (r.data, r.schema) for r in rows}
            _, schema = buckets.pop(_TABLE)
            (through,) = (r.through for r in rows if r.bucket == _TABLE)
            merged = {o: [tuple(x) for x in r] for o, r in json.loads(through).items()}
            self._last = Manifest(version, merged, schema, buckets)
        return self._last

    def _changes(self, spark: SparkSession, batches: list[Batch]) -> DataFrame | None:
        return _read(spark, [(f"{self.path}/{b.folder}", b.schema) for b in batches])

    def _base(self, spark: SparkSession, buckets: dict[int, tuple[str, str]]) -> DataFrame | None:
        files = [(f"{self.path}/base/version={data}/{_BUCKET}={b}", schema) for b, (data, schema) in buckets.items()]
        return _read(spark, files)


def _ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of numbers, those that touch as one: as many as there are gaps."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def _few(pending: list[Batch]) -> bool:
    """Whether the buffered changes are few enough for their keys to be broadcast."""
    return sum(b.records for b in pending) <= BROADCAST_RECORDS and sum(b.key_bytes for b in pending) <= BROADCAST_BYTES


def _read(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame | None:
    """Folders written under different schemas as one relation under their union."""
    by_schema: dict[str, list[str]] = {}
    for path, schema in files:
        by_schema.setdefault(schema, []).append(path)
    if not by_schema:
        return None
    schemas = {text: T.StructType.fromJson(json.loads(text)) for text in by_schema}
    union = reduce(merged_schema, schemas.values())
    parts = [conform(spark.read.schema(schemas[s]).parquet(*paths), union) for s, paths in by_schema.items()]
    return reduce(DataFrame.union, parts)
