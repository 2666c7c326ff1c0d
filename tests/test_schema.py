from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.lattice import merged_schema, relax, widen
from driftline.operators import schema as sch

I, L, D, S, B = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (I, I, I),
        (I, L, L),
        (L, D, D),
        (I, T.FloatType(), D),
        (I, S, S),
        (B, I, S),
        (T.NullType(), I, I),
        (T.DateType(), T.TimestampNTZType(), T.TimestampNTZType()),
        (T.DecimalType(10, 2), T.DecimalType(8, 4), T.DecimalType(12, 4)),
        (T.DecimalType(38, 0), T.DecimalType(38, 20), D),
        (T.ArrayType(I), T.ArrayType(L), T.ArrayType(L)),
        (T.ArrayType(I), I, S),
    ],
)
def test_widen(a, b, want):
    assert widen(a, b) == widen(b, a) == want


def test_widening_does_not_depend_on_order():
    kinds = [T.ByteType(), I, T.LongType(), T.FloatType(), T.DoubleType(), T.DecimalType(3, 1), T.DecimalType(38, 0), T.DecimalType(38, 38), T.DateType(), T.TimestampType(), T.TimestampNTZType(), S, T.NullType()]
    for a in kinds:
        for b in kinds:
            assert widen(a, b) == widen(b, a)
            for c in kinds:
                assert widen(widen(a, b), c) == widen(a, widen(b, c)), (a, b, c)
    assert widen(T.LongType(), T.DecimalType(3, 1)) == T.DecimalType(21, 1)
    assert widen(T.DecimalType(3, 1), T.DoubleType()) == T.DoubleType()
    assert widen(T.DateType(), T.TimestampType()) == T.TimestampType()


def test_merged_schema_keeps_order_and_requires_nothing():
    a = T.StructType([T.StructField("x", I, False), T.StructField("y", T.StructType([T.StructField("p", I, False)]))])
    b = T.StructType([T.StructField("z", S), T.StructField("y", T.StructType([T.StructField("q", S)]), False)])
    merged = merged_schema(a, b)
    assert merged.simpleString() == "struct<x:int,y:struct<p:int,q:string>,z:string>"
    assert all(f.nullable for f in merged.fields)
    assert all(f.nullable for f in merged["y"].dataType.fields)


def test_evolve_number_and_text(spark):
    a = spark.createDataFrame([(1, 5)], "id int, v int")
    b = spark.createDataFrame([(2**33, "five", True)], "id bigint, v string, extra boolean")
    assert sorted(tuple(r) for r in sch.evolve(a, b).collect()) == [(1, "5", None), (2**33, "five", True)]


def test_evolve_record_to_text(spark):
    a = spark.createDataFrame([((1,),)], "v struct<a:int>")
    b = spark.createDataFrame([("t",)], "v string")
    assert sorted(r.v for r in sch.evolve(a, b).collect()) == ["t", '{"a":1}']


def test_relaxed(spark):
    df = spark.range(3).select(F.col("id"), F.struct(F.lit(1).alias("a")).alias("s"))
    assert not df.schema["id"].nullable
    loose = sch.relaxed(df)
    assert loose.schema == relax(df.schema)
    assert loose.count() == 3


def test_ordered(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert sch.ordered(df, " c,a ").columns == ["c", "a"]
    assert sch.ordered(df, ["b"]).columns == ["b"]
    with pytest.raises(ValueError, match="nope"):
        sch.ordered(df, "a,nope")


TYPES = {
    "SERIAL": "int",
    "bigserial": "bigint",
    "Integer": "int",
    "VARCHAR(255)": "string",
    "character varying(10)": "string",
    "numeric": "string",
    "numeric(12,2)": "decimal(12,2)",
    "NUMERIC ( 8 )": "decimal(8,0)",
    "numeric(3,5)": "decimal(5,5)",
    "numeric(1000,2)": "string",
    "timestamp": "timestamp_ntz",
    "timestamp(6) without time zone": "timestamp_ntz",
    "timestamptz": "timestamp",
    "timestamp(3) with time zone": "timestamp",
    "TEXT[]": "array<string>",
    "_int8": "array<bigint>",
    "numeric(5,1)[]": "array<decimal(5,1)>",
    "jsonb": "string",
    "bytea": "binary",
    "double precision": "double",
    "boolean": "boolean",
    "geometry": "string",
}


def test_type_names(spark):
    rows = spark.createDataFrame([(k, v) for k, v in TYPES.items()], "data_type string, want string")
    got = {r.data_type: r.target_type for r in sch.map_types(rows).collect()}
    assert got == TYPES


def test_to_struct(spark):
    columns = spark.createDataFrame(
        [("b col", "text[]", 2), ("id", "serial", 1), ("d", "interval", 3)],
        "column_name string, data_type string, ordinal_position int",
    )
    struct = sch.to_struct(columns)
    assert struct.names == ["id", "b col", "d"]
    assert struct["b col"].dataType == T.ArrayType(S)
