"""Expensive columns that are computed one time per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column that later filters do not repeat.

    A filter on a computed column is moved below the projection with the column's whole expression
    written out in it, so a parsed text would be parsed once more for every use. A filter does not move
    below an ``explode``; exploding a one-element array keeps the rows as they are.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*[F.col(f"`{c}`") for c in rest], F.explode(F.array(column)).alias(name))
