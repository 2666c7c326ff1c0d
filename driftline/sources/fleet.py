"""The tables of a fleet read by one job, with an account of those that could not be read."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.names import TABLE
from driftline.streaming.commits import exists

#: A file's root and table: the last two folders of its path, plain or named as partitions are.
_PLACE = r"^(.*)/(?:schema=)?([^/]+)/(?:tbl=)?([^/]+)/[^/]+$"
#: Scheme and authority, which Spark's readers write in different ways.
_SCHEME = r"^[A-Za-z][A-Za-z0-9.+-]*:(?://[^/]*)?/*"

# Errors that an account names.
MISSING, NOTHING = "missing", "nothing could be read"


def _placed(df: DataFrame, roots: Mapping[str, str], path: str) -> DataFrame:
    plain = F.regexp_replace(path, _SCHEME, "/")
    database = F.lit(None).cast("string")
    if roots:
        names = [F.lit(x) for name, root in roots.items() for x in (re.sub(_SCHEME, "/", root).rstrip("/"), name)]
        database = F.try_element_at(F.create_map(*names), F.regexp_extract(plain, _PLACE, 1))
    return df.select(
        database.alias("database"),
        F.regexp_extract(plain, _PLACE, 2).alias("schema"),
        F.regexp_extract(plain, _PLACE, 3).alias("tbl"),
        *[c for c in df.columns if c != path],
    ).filter("database is not null")


def _there(spark: SparkSession, roots: Mapping[str, str]) -> dict[str, str]:
    """The databases whose folder is there."""
    return {database: root for database, root in roots.items() if exists(spark, root)}


def fleet_rows(spark: SparkSession, roots: Mapping[str, str], schema: T.StructType | str) -> DataFrame:
    """The rows of all tables below one folder per database (``<schema>/<tbl>/<file>``), each with its table.

    A file that is damaged or goes away while it is read gives the rows up to there, and does not stop the others. Files
    at another depth belong to no table.
    """
    there = _there(spark, roots)
    if not there:
        return _placed(spark.createDataFrame([], schema).withColumn("_path", F.lit("")), {}, "_path")
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").parquet(*there.values())
    return _placed(rows.select("*", F.col("_metadata.file_path").alias("_path")), there, "_path")


def fleet_files(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """(table, ``files``, ``bytes``) by the listing alone; no file is opened."""
    there = _there(spark, roots)
    listed = spark.createDataFrame([], "path string, length bigint")
    if there:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(there.values())).select("path", "length")
    return _placed(listed, there, "path").groupBy(*TABLE).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def accounts(inventory: DataFrame, rows: DataFrame, files: DataFrame, whole: bool = False) -> DataFrame:
    """Per table of the inventory (table, ``n``): ``read`` rows, ``status`` and ``error``.

    ``n`` is the number of rows that a table should have, NULL where it is not known; then a table of which
    nothing was read counts as failed. Rows are counted from the footers of the files; ``whole`` decodes every value, and
    so finds damage within. The inventory has a row per table, and tables that it does not list have no account.
    """
    own = [c for c in rows.columns if c not in TABLE]
    counted = F.count(F.xxhash64(*own)) if whole and own else F.count("*")
    read = rows.groupBy(*TABLE).agg(counted.alias("_read"))
    joined = inventory.select(*TABLE, "n").join(read, list(TABLE), "left").join(files.select(*TABLE, "files"), list(TABLE), "left")
    n = F.coalesce("_read", F.lit(0))
    short = F.concat(F.lit("read "), n.cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" rows"))
    error = (
        F.when(F.col("files").isNull(), MISSING)
        .when(F.col("n").isNull() & (n == 0), NOTHING)
        .when(n < F.col("n"), short)
    )
    done = joined.withColumn("error", error)
    return done.select(*TABLE, n.alias("read"), F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error")


def for_all(
    spark: SparkSession,
    roots: Mapping[str, str],
    inventory: DataFrame,
    schema: T.StructType | str,
    f: Callable[[DataFrame], DataFrame],
    whole: bool = False,
) -> DataFrame:
    """What ``f`` makes of the rows of all tables that could be read, beside ``status`` and ``error`` of every table.

    ``f`` gets one relation with the table on each row, and returns rows with the table; a table of which it returns none
    has NULL there. Rows of tables that failed are left out, not even the part that was read goes in.
    """
    rows = fleet_rows(spark, roots, schema)
    account = accounts(inventory, rows, fleet_files(spark, roots), whole)
    good = account.filter(F.col("status") == "ok").select(*TABLE)
    made = f(rows.join(good, list(TABLE), "left_semi"))
    return account.drop("read").join(made, list(TABLE), "left").select(*made.columns, "status", "error")
