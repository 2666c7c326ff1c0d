"""Bad records are set aside, not fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.once import once

CORRUPT = "_corrupt"


def parsed(raw: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Replace JSON text by its fields; ``_corrupt`` holds the text of records that do not parse."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    others = [c for c in raw.columns if c != column]
    record = once(raw, "_record", F.from_json(column, with_corrupt, options))
    return record.select(*others, "_record.*")


def quarantine(raw: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good records with their fields, and bad ones with their text."""
    records = parsed(raw, schema, column)
    others = [c for c in raw.columns if c != column]
    good = records.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = records.filter(F.col(CORRUPT).isNotNull()).select(*others, CORRUPT)
    return good, bad


def write_quarantined(
    batch: DataFrame, batch_id: int, schema: T.StructType, path: str, column: str = "value"
) -> DataFrame:
    """Write both sides of a micro-batch under ``path`` and return them with ``side`` good or bad.

    Records are parsed once; a replayed batch replaces itself.
    """
    where = f"{path}/batch={batch_id}"
    side = F.when(F.col(CORRUPT).isNull(), "good").otherwise("bad")
    records = parsed(batch, schema, column).withColumn("side", side)
    records.write.mode("overwrite").partitionBy("side").parquet(where)
    return batch.sparkSession.read.schema(records.schema).parquet(where)
