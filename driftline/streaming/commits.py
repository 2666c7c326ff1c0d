"""Which written versions count: small Parquet files beside the data.

A version's files are written first, by each attempt into a folder of its own. Then one file that names them is put
at ``<log>/<number column>=<n>``, unless one is there already. A reader sees that file or does not, so it sees
a version entirely or not at all; of several writers of one number the first wins, and the others are told.
"""

from __future__ import annotations

import os
from io import BytesIO
from uuid import uuid4

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def attempt(n: int) -> str:
    """A folder name for the files of number ``n`` that no other attempt uses."""
    return f"{n}-{uuid4().hex[:16]}"


def commit(spark: SparkSession, log: str, number: str, n: int, **columns: list) -> bool:
    """Put entry ``n``, its rows given by column, as one file; False if the entry is there already."""
    data = BytesIO()
    pq.write_table(pa.table(columns), data)
    return _put_if_absent(spark, f"{log}/{number}={n}/entry.parquet", data.getvalue())


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = _located(spark, path)
    return fs.exists(there)


def committed(spark: SparkSession, log: str, schema: str) -> DataFrame | None:
    """All entries, or None before the first commit."""
    try:
        return spark.read.schema(schema).parquet(log)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest(spark: SparkSession, log: str, number: str, seen: int = 0) -> int:
    """The last of entries numbered from 1 without a gap, 0 if there is none; ``seen`` is one known to be there."""
    if not seen:
        fs, folder = _located(spark, log)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        seen = max((int(n.partition("=")[2]) for n in names if n.startswith(f"{number}=")), default=0)
        # an attempt to put it may have left the folder without the entry
        while seen and not exists(spark, f"{log}/{number}={seen}/entry.parquet"):
            seen -= 1
    while exists(spark, f"{log}/{number}={seen + 1}/entry.parquet"):
        seen += 1
    return seen


def _located(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    fs, there = _located(spark, path)
    folder, name = path.rpartition("/")[0], f".{uuid4().hex}"
    if fs.getUri().getScheme() == "file":
        # Hadoop's local file system would replace what is there
        at = there.toUri().getPath()
        mine = os.path.join(os.path.dirname(at), name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(mine, "wb") as f:
            f.write(data)
        try:
            os.link(mine, at)
        except FileExistsError:
            return False
        finally:
            os.unlink(mine)
        return True
    _, mine = _located(spark, f"{folder}/{name}")
    out = fs.create(mine, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if not fs.exists(there) and fs.rename(mine, there):
        return True
    fs.delete(mine, False)
    return False


def entries(spark: SparkSession, paths: list[str], schema: str | StructType, root: str) -> DataFrame | None:
    """The entries in those of the folders under ``root`` that are there."""
    there = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schema).option("basePath", root).parquet(*there) if there else None

