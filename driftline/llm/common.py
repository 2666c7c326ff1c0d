"""What several operators share: words, folds, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.sessions import workspace

#: A word, for Spark's and Python's engines. ``bytes.split()`` cuts at exactly these separators.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(-1))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def repeats(rows: DataFrame, column: str) -> bool:
    """Whether a value other than null occurs in two rows."""
    return not rows.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").isEmpty()


def shipped(spark: SparkSession) -> None:
    """Gives the package to the tasks' Python, once a session; Spark serves the file from the driver."""
    context = spark.sparkContext
    if getattr(context, "_driftline_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="driftline-")) / "driftline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "driftline").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))
    context._driftline_shipped = True


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for functions of this package."""
    shipped(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one cut stay near ``most_bytes``; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def as_bytes(column: pa.Array) -> Sequence[bytes]:
    """Texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """The text cut after spaces or line ends into pieces of about ``most`` bytes; a longer run without any stays whole."""
    start = 0
    while len(text) - start > most:
        end = max(text.rfind(c, start, start + most) for c in (b" ", b"\n")) + 1
        end = end or min((e for c in (b" ", b"\n") if (e := text.find(c, start + most) + 1)), default=len(text))
        yield text[start:end]
        start = end
    yield text[start:]
