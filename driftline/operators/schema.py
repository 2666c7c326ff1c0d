"""Schemas that drift: union of fields, widening, relaxed nullability, explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.lattice import merged_schema, relax, spark_type


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the field order and types of ``schema``; fields it lacks are NULL."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def field(f: T.StructField):
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        if have[f.name] == f.dataType:
            return F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and isinstance(have[f.name], (T.StructType, T.MapType, T.ArrayType)):
            return F.to_json(f"`{f.name}`").alias(f.name)
        return F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)

    return df.select(*[field(f) for f in schema.fields])


def evolve(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State and batch together under the union of their schemas.

    Both sides are cast before the union, because a plain union of a number and a text would turn the
    text into a number and fail at run time.
    """
    schema = merged_schema(state.schema, batch.schema)
    return conform(state, schema).union(conform(batch, schema))


def relaxed(df: DataFrame) -> DataFrame:
    """The same rows under a schema that requires no field."""
    return df.sparkSession.createDataFrame([], relax(df.schema)).union(df)


def map_types(columns: DataFrame, type_col: str = "data_type") -> DataFrame:
    """Add ``target_type`` to a relation of columns."""
    return columns.withColumn("target_type", spark_type(F.col(type_col)))


def to_struct(columns: DataFrame) -> T.StructType:
    """The schema of one table from its rows (column_name, data_type, ordinal_position).

    One row per column of one table, of which a source table has at most 1,600.
    """
    rows = map_types(columns).orderBy("ordinal_position").select("column_name", "target_type").collect()
    kinds = ", ".join(f"`{r.column_name}` {r.target_type}" for r in rows)
    return T.StructType.fromDDL(kinds)


def ordered(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Only the listed columns, in that order; an unknown name is an error."""
    names = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns)
    unknown = [c for c in names if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*names)
