"""Nearest neighbours by an adaptive dimension scan within the probed lists of an inverted index.

Vectors are dealt to lists by their nearest centroid; the centroids are fitted by k-means to a bounded sample, all
vectors are indexed. A query looks into the lists of its nearest centroids. There the vectors, rotated by a random
orthogonal matrix, lie in blocks of columns. After a rotation the distance over some columns is an estimate of the
whole, so a candidate is given up as soon as a hypothesis test on its partial distance says that it lies beyond
the neighbours found so far; few candidates are read to the last column. Distances that count are taken from the
original vectors in double precision.

Equal vectors are one entry with the ``k`` + 1 least of their ids, more of which no result can hold, so a vector
that fills a third of the table costs one row. A list is cut into blocks of candidates and of queries, each pair of
which is a task's group of bounded size; no list is too large for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import in_tasks, written

#: Rows that the index is fitted to, and lists, at most.
SAMPLE, MOST_LISTS = 100_000, 4096
#: Share of the true neighbours, within the sample, that the probed lists must hold; and queries that tell.
RECALL, TRIALS = 0.97, 256
#: Candidates and queries of a group.
BLOCK, QUERY_BLOCK = 4096, 512
#: Columns of a block, and the width of the test: larger keeps more candidates for longer.
COLUMNS, WIDTH = 16, 2.1
SEED = 7


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows whose vector is not null, empty or zero and holds finite numbers only."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False)))


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means; a centroid that loses all its rows stays where it is."""
    rng = np.random.default_rng(SEED)
    found = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        own = nearest(sample, found, 1)[:, 0]
        n = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def nearest(x: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n nearest centroids of each row, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        away = (found**2).sum(axis=1) - 2 * part @ found.T
        near = np.argpartition(away, min(n, len(found)) - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def probes_for(sample: np.ndarray, found: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The least number of lists that hold the share ``recall`` of the ``k`` nearest in the sample of some of its rows.

    In the whole table the neighbours are nearer than in a sample, and so are their lists.
    """
    own = nearest(sample, found, 1)[:, 0]
    tried = sample[np.random.default_rng(SEED).choice(len(sample), min(TRIALS, len(sample)), replace=False)]
    places = []
    for query, order in zip(tried, nearest(tried, found, len(found)), strict=True):
        away = ((sample - query) ** 2).sum(axis=1)
        near = np.argpartition(away, min(k + 1, len(away)) - 1)[: k + 1]
        place = np.empty(len(found), np.int64)
        place[order] = np.arange(len(found))
        places.append(place[own[near]])
    return int(np.quantile(np.concatenate(places), recall, method="higher")) + 1


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def scan(x: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and rows of ``x`` that hold its k nearest with their squared distances.

    The rows are read in portions that double, so that the distance to beat sinks early; within a portion column
    block by column block, with those rows only that pass the test.
    """
    d = x.shape[1]
    turn = rotation(d)
    turned, asked = x @ turn, queries @ turn
    blocks = [(c, min(c + COLUMNS, d), np.ascontiguousarray(turned[:, c : c + COLUMNS])) for c in range(0, d, COLUMNS)]
    for q, target in enumerate(asked):
        beat = np.inf
        rows, away = np.zeros(0, np.int64), np.zeros(0)
        start, size = 0, max(64, 4 * k)
        while start < len(x):
            alive = np.arange(start, min(start + size, len(x)))
            partial = np.zeros(len(alive))
            for a, b, block in blocks:
                partial += ((block[alive] - target[a:b]) ** 2).sum(axis=1)
                if b < d and np.isfinite(beat):
                    passed = partial <= beat * (b / d) * (1 + WIDTH / np.sqrt(b)) ** 2
                    alive, partial = alive[passed], partial[passed]
            rows, away = np.concatenate((rows, alive)), np.concatenate((away, partial))
            if len(rows) > k:
                beat = np.partition(away, k - 1)[k - 1] * (1 + 1e-9)
                rows, away = rows[away <= beat], away[away <= beat]
            elif len(rows) == k:
                beat = away.max() * (1 + 1e-9)
            start, size = start + size, size * 2
        yield q, rows, ((x[rows] - queries[q]) ** 2).sum(axis=1)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    probes: int | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` its ``k`` nearest rows of ``vectors`` that were
    found, nearest first, ties to the smaller id, the row of its own id left out. ``score`` is the Euclidean distance.

    Rows without an id or a usable vector take no part, nor do vectors of another length than most have. Without
    ``probes`` the number of lists is found on the sample; a query looks into more where these hold too few rows. Ids are taken for unique; rows that
    repeat an id count as several candidates. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    all_rows = usable(vectors, id_col, vec_col)
    length = all_rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return empty
    d = length[0]["d"]
    in_turn = Window.partitionBy("vec").orderBy("id")
    few = all_rows.filter(F.size("vec") == d).withColumn("n", F.row_number().over(in_turn)).filter(F.col("n") <= k + 1)
    entries = written(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "ann-entries")
    asked = usable(queries, id_col, vec_col).filter(F.size("vec") == d).select("id", "vec")
    asked = written(asked.select(F.col("id").alias("query_id"), "vec").join(entries.select("vec", "rep"), "vec", "left").withColumn("key", F.coalesce("rep", "query_id")), "ann-queries")

    n = entries.count()
    lists = int(np.clip(round(np.sqrt(n)), 1, MOST_LISTS))
    sample = entries.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow()
    sample = _matrix(sample["vec"])
    centres = centroids(sample, lists)
    probes = probes or probes_for(sample, centres, k)
    sent = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = nearest(_matrix(batch.column(2)), sent.value, 1)[:, 0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], ["list", "rep", "ids", "vec"])

    dealt = written(in_tasks(entries.select("rep", "ids", "vec"), deal, "list int, rep long, ids array<long>, vec array<double>"), "ann-lists")
    sizes = {r["list"]: (r["rows"], r["ids"]) for r in dealt.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("ids")).alias("ids")).collect()}
    held = np.array([sizes.get(i, (0, 0))[1] for i in range(len(centres))])
    sent_held = spark.sparkContext.broadcast(held)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent_held.value
        for batch in batches:
            near = nearest(_matrix(batch.column(1)), sent.value, len(held)) if batch.num_rows else np.zeros((0, 1), int)
            before = np.cumsum(held[near], axis=1) - held[near]
            use = (np.arange(near.shape[1]) < probes) | (before < 4 * (k + 1))
            use &= held[near] > 0
            row, at = np.nonzero(use)
            yield pa.RecordBatch.from_arrays([pa.array(near[row, at], pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["list", "key", "vec"])

    distinct = asked.dropDuplicates(["key"]).select("key", "vec")
    probing = written(in_tasks(distinct, probe, "list int, key long, vec array<double>"), "ann-probes")
    blocks = spark.createDataFrame([(i, -(-rows // BLOCK)) for i, (rows, _) in sizes.items()], "list int, blocks int")
    asked_of = probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("asks"))
    shape = F.broadcast(blocks.join(asked_of, "list"))  # one row per list, MOST_LISTS at most
    candidates = (
        dealt.join(shape, "list")
        .withColumn("c", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        .select("list", "c", F.col("q").cast("long").alias("q"), "rep", "ids", "vec")
    )
    questions = (
        probing.join(shape, "list")
        .withColumn("q", F.pmod(F.xxhash64("key"), F.col("asks")))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("list", F.col("c").cast("long").alias("c"), "q", "key", "vec")
    )

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        x, reps = _matrix(left["vec"]), left["rep"].to_numpy()
        keys, rows, away = [], [], []
        if len(x):
            for q, found, squares in scan(x, _matrix(right["vec"]), k + 1):
                best = np.lexsort((reps[found], squares))[: k + 1]
                keys.append(np.full(len(best), q))
                rows.append(found[best])
                away.append(np.sqrt(squares[best]))
        take = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        rows_, keys_ = pa.array(take(rows, np.int64)), pa.array(take(keys, np.int64))
        return pa.table({"key": right["key"].take(keys_), "ids": left["ids"].take(rows_), "score": pa.array(take(away, float))})

    by = ["list", "c", "q"]
    found = candidates.groupBy(*by).cogroup(questions.groupBy(*by)).applyInArrow(match, "key long, ids array<long>, score double")
    best = Window.partitionBy("key").orderBy("score", "id")
    found = found.select("key", "score", F.explode("ids").alias("id")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    top = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("top"))
    own = F.slice(F.filter("top", lambda x: x["id"] != F.col("query_id")), 1, k)
    return asked.join(top, "key").select("query_id", F.posexplode(own).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"), F.col("hit.score").alias("score")
    )
