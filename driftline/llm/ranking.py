"""Ranked lexical search by dense blocked matrix multiplication.

The items' distinct terms are the vocabulary. One pass over the documents keeps each document's length and its
counts of vocabulary terms, a second one counts the documents of each term, and the third multiplies: a block of
items over a tile of its own compact vocabulary (occurrences times weight) times the same tile over a block of
documents (impacts), in float64. All factors are whole numbers, and a tile is so narrow that no partial sum can
reach 2^53; thus every product is exact whatever the order of additions, and tiles are added up in 64-bit integers.
Of each product a task keeps the ``k`` best documents of an item, with all that tie with the last of them until ids
have decided.

Items are taken in parts of about ``PART`` bytes of text, each a pass over the documents; only a part's terms and
their numbers of documents reach the driver and the tasks, so that both stay bounded however many items there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import as_bytes, in_tasks, pieces, slices, written

#: Bytes of item texts that are searched in one pass over the documents.
PART = 1 << 18
#: Items and documents of a product, and terms of a tile.
ITEMS, DOCS, TERMS = 256, 512, 2048
#: Float64 holds every whole number up to here.
EXACT = 1 << 53
#: No impact reaches this.
UNIT = 1_000_000
_CUT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists: runs of ASCII letters, digits and all other signs beyond ASCII."""
    for piece in pieces(text.translate(_CUT)):
        yield piece.split()


def _numbered(text: bytes, number: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """The terms of a text, and how often each numbered one occurs."""
    n, found = 0, Counter()
    for some in terms(text):
        n += len(some)
        found.update(filter(None, map(number.get, some)))
    return n, found


def term_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs) per document with a term; numbers of terms start at one."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(sent.value, 1)}
        for batch in slices(batches, 1):
            found = [_numbered(text, number) for text in as_bytes(batch.column(1))]
            has = [i for i, (n, _) in enumerate(found) if n]
            ends = np.cumsum([0] + [len(found[i][1]) for i in has]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(np.fromiter((x for i in has for x in side(found[i][1])), np.int32, ends[-1])))
                for side in (dict.keys, dict.values)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(has, pa.int64())), pa.array([found[i][0] for i in has], pa.int64()), *lists], ["id", "n", "terms", "tfs"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_tasks(rows, run, "id long, n long, terms array<int>, tfs array<int>")


def statistics(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms of all documents, and documents of each of ``size`` numbered terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = [0, 0], np.zeros(size + 1, np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            total[1] += int(batch.column(0).to_numpy().sum())
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size + 1)
        held = np.flatnonzero(df)
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *held], pa.int64()), pa.array([*total, *df[held]], pa.int64())], ["term", "n"])

    # at most one row per term of the part
    rows = in_tasks(counts.select("n", "terms"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist(), strict=True))
    df = np.zeros(size + 1, np.int64)
    for term, n in found.items():
        if term > 0:
            df[term] = n
    return found.get(-1, 0), found.get(-2, 0), df


def tiles(parts: np.ndarray, width: int = TERMS, limit: int = EXACT) -> Iterator[tuple[int, int, bool]]:
    """Cuts columns of (items, terms) whole-number factors of impacts into tiles whose sums stay below ``limit``.

    Yields begin, end and whether float64 is exact; it is not for a column that goes beyond the limit by itself.
    """

    def cut(a: int, b: int) -> Iterator[tuple[int, int, bool]]:
        fits = not len(parts) or int(parts[:, a:b].sum(axis=1).max()) < limit // UNIT
        if fits or b - a == 1:
            yield a, b, fits
        else:
            yield from cut(a, (a + b) // 2)
            yield from cut((a + b) // 2, b)

    for a in range(0, parts.shape[1], width):
        yield from cut(a, min(a + width, parts.shape[1]))


class Best:
    """The ``k`` best documents of each item so far: highest score first, then the smallest id, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * items

    def add(self, first: int, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        """Scores (items, documents) of the items from number ``first`` on."""
        if scores.shape[1] > self.k:
            least = np.partition(scores, -self.k, axis=1)[:, -self.k]
        else:
            least = np.zeros(len(scores), np.int64)
        least = np.maximum(least, self.floor[first : first + len(scores)])
        keep = scores >= least[:, None]
        for i in np.flatnonzero(keep.any(axis=1)):
            own = np.flatnonzero(keep[i])
            s, m, d = (np.concatenate(x) for x in zip(self.rows[first + i], (scores[i, own], missing[own], ids[own]), strict=True))
            order = np.lexsort((d, m, -s))[: self.k]
            self.rows[first + i] = s[order], m[order], d[order]
            if len(order) == self.k:
                self.floor[first + i] = s[order[-1]]


def _blocks(queries: list[dict[int, int]], weight: np.ndarray, size: int) -> list[tuple[int, np.ndarray, list[dict[int, int]]]]:
    """First item, compact vocabulary and items of each block of ``size``; terms without weight add nothing."""
    out = []
    for a in range(0, len(queries), size):
        some = [{t: n for t, n in q.items() if weight[t]} for q in queries[a : a + size]]
        own = np.unique(np.fromiter((t for q in some for t in q), np.int64))
        if len(own):
            out.append((a, own, some))
    return out


def _factors(own: np.ndarray, some: list[dict[int, int]], weight: np.ndarray) -> np.ndarray:
    """(items, terms of one tile): occurrences times weight."""
    out = np.zeros((len(some), len(own)), np.int64)
    place = {t: i for i, t in enumerate(own.tolist())}
    for i, q in enumerate(some):
        for t, n in q.items():
            if (at := place.get(t)) is not None:
                out[i, at] = n * weight[t]
    return out


def best_documents(counts: DataFrame, queries: list[dict[int, int]], weight: np.ndarray, n_docs: int, n_terms: int, k: int, limit: int = EXACT) -> DataFrame:
    """(item, id, score): each task's ``k`` best documents of each query of numbered terms."""
    sent = counts.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = sent.value
        best = Best(len(queries), k)
        # (first item, terms, factors as float64 or as integers) of every tile, in the order of items
        work = []
        for first, own, some in _blocks(queries, weight, ITEMS):
            for a in range(0, len(own), TERMS):
                factors = _factors(own[a : a + TERMS], some, weight)
                for b, e, fits in tiles(factors, limit=limit):
                    work.append((first, own[a + b : a + e], factors[:, b:e].astype(np.float64 if fits else np.int64)))
        local = np.full(len(weight), -1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                some = batch.slice(at, DOCS)
                lists = some.column(2)
                size = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(some.num_rows), size)
                term = lists.flatten().to_numpy()
                tf = some.column(3).flatten().to_numpy().astype(np.int64)
                m = np.array([25 + 75 * n * n_docs // n_terms for n in some.column(1).to_pylist()], np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                ids = some.column(0)
                missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                scores, of = None, None
                for first, own, factors in work:
                    if of != first:
                        if of is not None:
                            best.add(of, scores, missing, ids)
                        scores, of = np.zeros((len(factors), some.num_rows), np.int64), first
                    local[own] = np.arange(len(own))
                    column = local[term]
                    local[own] = -1
                    has = column >= 0
                    tile = np.zeros((len(own), some.num_rows), factors.dtype)
                    tile[column[has], doc[has]] = impact[has]
                    scores += (factors @ tile).astype(np.int64, copy=False)
                if of is not None:
                    best.add(of, scores, missing, ids)
        for item, (s, gone, d) in enumerate(best.rows):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), item)), pa.array(d, mask=gone), pa.array(s)], ["item", "id", "score"])

    return in_tasks(counts.select("id", "n", "terms", "tfs"), run, "item long, id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    part: int = PART,
    limit: int = EXACT,
) -> DataFrame:
    """(item_id, rank, id, score): the ``k`` documents of highest score above zero of each item, all if fewer.

    A null text has no terms; a document or item without terms is found by nothing and finds nothing. Every row of
    ``docs`` is a document of its own, also where ids repeat; equal scores go by ascending id, null ids last. Equal
    rows of ``items`` count once; different texts of one id are items of their own, each with its own ranks. Other
    columns are not looked at. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null").distinct()
    asked = written(asked, "ranking-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part))
    found = []
    for p in range(parts):
        some = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p).orderBy("item", "text").toArrow()
        names = some["item"].to_pylist()
        texts = [sum((Counter(x) for x in terms(t)), Counter()) for t in as_bytes(some["text"].combine_chunks())] if names else []
        vocabulary = sorted(set().union(*texts))
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary, 1)}
        queries = [{number[t]: n for t, n in q.items()} for q in texts]
        counts = written(term_counts(docs, vocabulary, id_col, text_col), "ranking-counts")
        n_docs, n_terms, df = statistics(counts, len(vocabulary))
        if not n_docs:
            continue
        weight = np.array([0] + [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df[1:]], np.int64)
        own = best_documents(counts, queries, weight, n_docs, n_terms, k, limit)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        top = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(names)), "number long, item_id long")  # the items of the part
        top = top.join(F.broadcast(named), F.col("item") == F.col("number")).select("item_id", "rank", "id", "score")
        found.append(written(top, "ranking-best") if parts > 1 else top)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, id long, score long")
    return reduce(DataFrame.unionAll, found)
