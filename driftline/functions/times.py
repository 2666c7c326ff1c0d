"""Points in time as arguments. No operator reads the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment(at: str | datetime | Column, like: DataFrame, column: str) -> Column:
    """``at`` in the type of ``column``, whatever the session's time zone is."""
    if isinstance(at, Column):
        return at
    return F.lit(str(at)).cast(like.schema[column].dataType)


def seconds(n: int | Column) -> Column:
    """A day-time interval of ``n`` seconds."""
    return F.make_dt_interval(secs=F.lit(n).cast("decimal(18,6)") if isinstance(n, int) else n.cast("decimal(18,6)"))


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since 1970; a time without zone counts as UTC."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    return F.unix_seconds(F.col(column))
