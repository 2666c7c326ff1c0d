"""The change stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_changes(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    format: str = "parquet",
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Change files as a stream, from the earliest on; the checkpoint of the reader resumes it.

    Files may arrive in any order, because changes are ordered by ``lsn`` and never by arrival or by a
    watermark. ``max_files`` or ``max_bytes`` bounds a micro-batch.
    """
    reader = spark.readStream.format(format).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)


Decoder = Callable[[Column], Column]


def json_of(schema: T.StructType | str) -> Decoder:
    """Decoder for JSON bytes. For Avro pass one built on ``from_avro`` instead."""
    return lambda payload: F.from_json(payload.cast("string"), schema)


def read_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    key: Decoder,
    after: Decoder,
    start: str = "earliest",
    max_offsets: int | None = None,
) -> DataFrame:
    """The same from a topic, as envelopes; needs the Kafka package on the cluster."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return envelopes(reader.load(), key, after)


def envelopes(messages: DataFrame, key: Decoder, after: Decoder) -> DataFrame:
    """Keyed messages (``key``, ``value``, ``offset``, ``timestamp``) as change envelopes.

    A message without value is a tombstone, that is a delete. The offset serves as ``lsn``: a key stays
    within one topic partition, where offsets only grow.
    """
    return messages.select(
        key(F.col("key")).alias("key"),
        F.when(F.col("value").isNull(), "d").otherwise("u").alias("op"),
        F.col("offset").alias("lsn"),
        F.col("timestamp").alias("ts"),
        after(F.col("value")).alias("after"),
    )
