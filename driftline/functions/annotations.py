"""The JSON annotation a table carries in its comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.once import once

# JSON texts that count as "not enabled" besides every spelling of zero.
FALSY = ("false", "null", '""', "[]", "{}")


def _truthy(value: Column) -> Column:
    text = F.to_json(value)
    zero = ~text.startswith('"') & (F.coalesce(text.try_cast("double"), F.lit(1.0)) == 0)
    return F.coalesce(~text.isin(*FALSY) & ~zero, F.lit(False))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _target_text(value: Column) -> Column:
    """Text of the target entry: strings as they are, other JSON values as their JSON text."""
    text = F.to_json(value)
    booleans = F.when(text == "true", "True").when(text == "false", "False")
    return F.when(
        ~F.is_variant_null(value),
        F.coalesce(booleans, F.when(text.startswith('"'), F.try_variant_get(value, "$", "string")), text),
    )


def parse_annotations(df: DataFrame, comment_col: str = "comment") -> DataFrame:
    """Add ``annotation struct<enabled, target_schema, target_table>``; NULL where there is none.

    ``enabled`` follows JSON truthiness, so the text ``"false"`` is true and ``0`` is false. A target
    without a dot names the schema only; parts after the second are ignored.
    """
    staged = df.withColumn("_root", F.try_parse_json(F.col(comment_col))).withColumn(
        "_boot", F.try_variant_get("_root", "$.bootstrap", "variant")
    )
    is_object = F.to_json("_root").startswith("{")
    annotated = is_object & (F.col("_boot").isNull() | F.to_json("_boot").startswith("{"))
    staged = (
        staged.withColumn("_enabled", _truthy(F.try_variant_get("_boot", "$.enabled", "variant")))
        .withColumn("_target", _strip(_target_text(F.try_variant_get("_boot", "$.bq", "variant"))))
        .withColumn("_parts", F.split("_target", r"\."))
    )
    part = lambda i: F.nullif(F.try_element_at("_parts", F.lit(i)), F.lit(""))
    annotation = F.when(
        F.coalesce(annotated, F.lit(False)),
        F.struct(
            F.col("_enabled").alias("enabled"),
            part(1).alias("target_schema"),
            part(2).alias("target_table"),
        ),
    )
    return once(staged, "annotation", annotation).drop("_root", "_boot", "_enabled", "_target", "_parts")
