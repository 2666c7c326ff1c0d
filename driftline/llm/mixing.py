"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. Within a source the rows are ordered by it and cut into ranges, the sizes of
the ranges are summed up, and a row's place in its source is the sum of the ranges before its own plus the sum
of the rows before it in its range. A source of any size is thus dealt over as many tasks as it has ranges; no
window holds more than a range. A source takes its whole rows as often as its target holds them, and of the
last round the words whose place lies before the rest.

Rows without a source form a source of their own, the last; rows without an id are named by their content;
rows of one id are told apart by size and content, and equal rows get equal or neighbouring places. A null text
has no words. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, repeats, written

#: No source, and so no row, is taken more often than this.
MOST_EPOCHS = 3
#: Rows of a range, on average; a range is ordered by one task.
RANGE_ROWS = 2048


def words_in(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle(place: Column) -> Column:
    """The weight of the source at a place from 0: 1, 2, 3, repeating."""
    return (place % 3 + 1).cast("long")


def targets(sources: DataFrame, weight: Callable[[Column], Column] = cycle, most: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target``.

    The sources share the sum of the sizes by weight, in the order of their code points, null last. A target
    stops at ``most`` times its source's size and the excess is shared by weight among the others, until none
    is above. That ends where all sources that are not stopped have one target per weight. Taken by rising
    limit per weight, a source is stopped if its limit is no more than its share of what the earlier ones
    left, and the first that is not stopped sets the level. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("place"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(0))
    return (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight(F.col("place")))
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("rank", F.row_number().over(by_room))
        .withColumn("left", F.sum("source_size").over(everywhere) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stopped", F.col("limit") * F.col("weights") <= F.col("left") * F.col("weight"))
        .withColumn("level", F.min(F.when(~F.col("stopped"), F.struct("rank", "left", "weights"))).over(everywhere))
        .withColumn("above", F.coalesce(F.col("rank") < F.col("level.rank"), F.lit(True)))
        .withColumn("target", F.when(F.col("above"), F.col("limit").cast("double")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.weights")))
        .drop("place", "weight", "limit", "rank", "left", "weights", "stopped", "level", "above")
    )


def _named(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, size, name, twin): the name is unique but for rows of one id, which ``twin`` tells apart."""
    text, id_ = F.col(text_col), F.col(id_col)
    content = F.xxhash64(F.col(source_col), text)
    return docs.select(
        id_.alias("id"),
        F.col(source_col).cast("string").alias("source"),
        words_in(text).alias("size"),
        F.coalesce(id_.cast("string"), F.concat(F.lit("~"), F.hex(content))).alias("name"),
        content.alias("twin"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weight: Callable[[Column], Column] = cycle,
    most: int = MOST_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: (id, source, size, name, twin, source_size, target, epochs, rest, taken).

    ``taken`` words are taken of the row: ``size`` in each of ``epochs`` whole rounds, and ``rest`` of its first
    words in the last one. A source's taken words differ from its target by less than one word.
    """
    rows = written(
        _named(docs, id_col, source_col, text_col).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), "name"))),
        "mix-rows",
    )
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weight, most)
    per_source = per_source.withColumnRenamed("source", "its").withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS))
    start = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = rows.join(per_source, F.col("source").eqNullSafe(F.col("its"))).withColumn("range", F.floor(start * F.col("ranges") / (1 << 32)))
    by_range = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        placed.groupBy(F.col("source").alias("of"), F.col("range").alias("at"))
        .agg(F.sum("size").alias("sum"))
        .select("of", "at", F.coalesce(F.sum("sum").over(by_range), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("source", "range").orderBy("key", "name", "size", "twin").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.floor(F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0)))
    return (
        placed.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
        .withColumn("place", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("epochs", whole.cast("long"))
        .withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
        .withColumn("rest", F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("place"))).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("rest"))
        .select("id", "source", "size", "name", "twin", "source_size", "target", "epochs", "rest", "taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a row for each whole round that takes it, and one for a
    part, whose text is cut to the words taken, joined by one space. Rows of which nothing is taken are left out.
    """
    plan = written(mix(docs, id_col, source_col, text_col, **options), "mix-plan")
    taken = plan.filter("taken > 0").select(*[F.col(c).alias(f"__{c}") for c in ("name", "size", "twin", "epochs", "rest")])
    content = F.xxhash64(F.col(source_col), F.col(text_col))
    named = docs.withColumn("__name", F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.hex(content))))
    if repeats(plan, "name"):  # rows of one name are matched in turn
        alike = Window.partitionBy("__name", "__size", "__twin")
        taken = taken.withColumn("__turn", F.row_number().over(alike.orderBy(F.desc("__epochs"), F.desc("__rest"))))
        named = named.withColumn("__size", words_in(F.col(text_col))).withColumn("__twin", content)
        named = named.withColumn("__turn", F.row_number().over(alike.orderBy(F.lit(0))))
        joined = named.join(taken, ["__name", "__size", "__twin", "__turn"])
    else:
        joined = named.join(taken.hint("shuffle_hash"), "__name")
    parts = F.concat(F.array_repeat(F.lit(False), F.col("__epochs").cast("int")), F.array_repeat(F.lit(True), F.when(F.col("__rest") > 0, 1).otherwise(0)))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__rest").cast("int")), " ")
    text = F.when(F.col("__part") & (F.col("__rest") < F.col("__size")), cut).otherwise(F.col(text_col))
    return joined.withColumn("__part", F.explode(parts)).withColumn(text_col, text).select(*[F.col(c) for c in docs.columns])
