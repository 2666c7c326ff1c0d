"""Source type names and the order in which column types widen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# PostgreSQL type name -> Spark type.
SOURCE_TYPES = {
    "smallint": "smallint",
    "int2": "smallint",
    "smallserial": "smallint",
    "integer": "int",
    "int": "int",
    "int4": "int",
    "serial": "int",
    "bigint": "bigint",
    "int8": "bigint",
    "bigserial": "bigint",
    "real": "float",
    "float4": "float",
    "double precision": "double",
    "float8": "double",
    "numeric": "string",  # without a precision it has no bound that a decimal could hold
    "decimal": "string",
    "money": "decimal(19,2)",
    "boolean": "boolean",
    "bool": "boolean",
    "text": "string",
    "varchar": "string",
    "character varying": "string",
    "char": "string",
    "character": "string",
    "bpchar": "string",
    "uuid": "string",
    "json": "string",
    "jsonb": "string",
    "bytea": "binary",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamp without time zone": "timestamp_ntz",
    "timestamptz": "timestamp",
    "timestamp with time zone": "timestamp",
    "interval": "string",  # months and days beside seconds
}

_INTEGRAL = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
# Digits of the integral types; 20 for the largest, as Spark counts when it unites numbers of JSON documents.
_DIGITS = dict(zip(_INTEGRAL, (3, 5, 10, 20), strict=True))


def spark_type(type_name: Column) -> Column:
    """Spark type for a source type name; text for names that are not known.

    ``numeric(p,s)`` keeps its precision, lengths of character types are dropped, ``t[]`` and ``_t``
    become arrays of the mapped element type.
    """
    name = F.lower(F.trim(type_name))
    is_array = name.endswith("[]") | name.startswith("_")
    element = F.trim(F.regexp_replace(name, r"^_|(\[\])+$", ""))
    base = F.trim(F.regexp_replace(element, r"\s*\([^)]*\)", ""))
    sizes = r"^(?:numeric|decimal)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)$"
    scale = F.coalesce(F.regexp_extract(element, sizes, 2).try_cast("int"), F.lit(0))
    precision = F.greatest(F.regexp_extract(element, sizes, 1).try_cast("int"), scale)
    known = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    mapped = F.when(
        F.regexp_like(element, F.lit(sizes)) & (precision <= 38), F.format_string("decimal(%d,%d)", precision, scale)
    ).otherwise(F.coalesce(F.try_element_at(known, base), F.lit("string")))
    return F.when(is_array, F.concat(F.lit("array<"), mapped, F.lit(">"))).otherwise(mapped)


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both: integers widen, then decimals, then double; dates, then timestamps; then text.

    The order in which types come does not matter, so that a stream cut into other batches ends with the same type.
    """
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged_schema(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widen(a.elementType, b.elementType), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, widen(a.valueType, b.valueType), True)
    if a in _INTEGRAL and b in _INTEGRAL:
        return max(a, b, key=_INTEGRAL.index)
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return _wider_number(a, b)
    kinds = {type(a), type(b)}
    if kinds == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if kinds == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def _wider_number(a: T.NumericType, b: T.NumericType) -> T.NumericType:
    """A decimal that holds both exactly, if there is one and neither is a floating point number; else double."""
    if isinstance(a, T.FractionalType) and not isinstance(a, T.DecimalType):
        return T.DoubleType()
    if isinstance(b, T.FractionalType) and not isinstance(b, T.DecimalType):
        return T.DoubleType()
    scale = max(getattr(a, "scale", 0), getattr(b, "scale", 0))
    whole = max(k.precision - k.scale if isinstance(k, T.DecimalType) else _DIGITS[k] for k in (a, b))
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()


def present(kind: T.StructType) -> T.StructType:
    """Without the fields that were NULL throughout, or records of only such: they are merely absent. Lists that were
    empty throughout hold text."""

    def known(inner: T.DataType) -> T.DataType:
        if isinstance(inner, T.StructType):
            return present(inner)
        if isinstance(inner, T.ArrayType):
            return T.ArrayType(T.StringType() if isinstance(inner.elementType, T.NullType) else known(inner.elementType), True)
        return inner

    fields = [T.StructField(f.name, known(f.dataType), True) for f in kind.fields if not isinstance(f.dataType, T.NullType)]
    return T.StructType([f for f in fields if f.dataType != T.StructType([])])


def merged_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    """Union of the field sets, ``a``'s order first, every field nullable."""
    theirs = {f.name: f.dataType for f in b.fields}
    fields = [T.StructField(f.name, widen(f.dataType, theirs.pop(f.name, f.dataType)), True) for f in a.fields]
    fields += [T.StructField(name, kind, True) for name, kind in theirs.items()]
    return relax(T.StructType(fields))


def relax(kind: T.DataType) -> T.DataType:
    """The same type with every field, element and value allowed to be NULL."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, relax(f.dataType), True, f.metadata) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(relax(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, relax(kind.valueType), True)
    return kind
