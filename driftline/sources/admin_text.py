"""Text listings of the storage administration tool, one line per row (``value``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.once import once

# Shapes of the lines.
STREAM_ID = r"(?i)CDC Stream ID:\s*([0-9a-f]{32})"
STREAM_TABLE = r'^\s*table_id:\s*"([0-9a-fA-F]+)"'
NAMESPACE = "ysql."
SCHEMA_TAG = "ysql_schema="


def parse_stream_id(lines: DataFrame) -> DataFrame:
    """Ids of newly created change streams."""
    found = F.regexp_extract("value", STREAM_ID, 1)
    return lines.withColumn("stream_id", found).filter(F.col("stream_id") != "").drop("value")


def parse_stream_info(lines: DataFrame) -> DataFrame:
    """Distinct ids of the tables on a stream; further columns (such as the stream) are kept."""
    found = F.regexp_extract("value", STREAM_TABLE, 1)
    return lines.withColumn("table_id", found).filter(F.col("table_id") != "").drop("value").distinct()


def parse_table_listing(lines: DataFrame) -> DataFrame:
    """``ysql.<database>.<table> [ysql_schema=<schema>] [<id>] [...]``; shorter lines are skipped."""
    inner = lambda i: F.expr(f"substring(_p[{i}], 2, greatest(length(_p[{i}]) - 2, 0))")
    words = F.split(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    parts = (
        once(lines, "_p", words)
        .filter(F.size("_p") >= 4)
        .select(F.col("_p")[0].alias("_name"), inner(1).alias("_schema"), inner(2).alias("table_id"))
        .filter(F.col("_name").rlike(r"^ysql\.[^.]+\.") & F.col("_schema").startswith(SCHEMA_TAG))
    )
    return parts.select(
        F.split("_name", r"\.", 3)[1].alias("database"),
        F.expr(f"substring(_schema, {len(SCHEMA_TAG) + 1})").alias("schema"),
        F.split("_name", r"\.", 3)[2].alias("tbl"),
        "table_id",
    )
