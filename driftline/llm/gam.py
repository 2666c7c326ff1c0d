"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into one of its bins, and a bin has an addend to the log-odds. The tables of addends
are learned by cyclic boosting: in every round each feature in turn gets a shallow tree, fitted by Newton steps to
what all tables together leave over, and the tree is added to its table, at a small rate. Then the pairs of
features that explain most of the rest get tables of two dimensions in the same way. A score is a sum of look-ups
for whole columns of documents.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows, those whose ids hash lowest; all else
runs in tasks. Language, source, labels and ids are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import as_bytes, in_tasks, slices
from driftline.llm.rules import repeated_lines, repeated_words

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, MIN_WEIGHT, RIDGE = 150, 60, 0.1, 3.0, 1.0
#: A document is taken for good from this score on.
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "longest_word", "capitals", "signs", "pipes", "exclamations", "digits", "stops",
    "brackets", "other_bytes", "vowels", "distinct", "commonest", "short_words", "words_in_line", "repeated_lines",
    "repeated_words", "links",
)
_CLASSES = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "signs": b"#*$%&^~=+_", "pipes": b"|<>\\", "exclamations": b"!?",
    "digits": b"0123456789", "stops": b".,;:", "brackets": b"()[]{}\"'", "vowels": b"aeiouyAEIOUY", "links": b"@/",
}
_LETTERS = np.array([c for c in range(128) if chr(c).isalpha()])


def measure(texts: list[bytes]) -> np.ndarray:
    """The features of texts (texts, features); a text without words has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    cut = [t.split() for t in texts]
    number = {w: i for i, w in enumerate(set().union(*cut))}
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    borders = np.concatenate(([0], np.cumsum(counts)))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(borders[-1]))
    size = np.fromiter(map(len, number), np.int64, len(number))[ids]
    column = {name: i for i, name in enumerate(FEATURES)}
    classes = [(column[k], np.frombuffer(v, np.uint8)) for k, v in _CLASSES.items()]
    for row, text, a, b in zip(out, texts, borders[:-1], borders[1:], strict=True):
        n = b - a
        if not n:
            continue
        seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        own, own_size = ids[a:b], size[a:b]
        letters = max(1, seen[_LETTERS].sum())
        for k, members in classes:
            row[k] = seen[members].sum() / n
        row[column["capitals"]] *= n / letters
        row[column["vowels"]] *= n / letters
        row[column["other_bytes"]] = seen[128:].sum() / len(text)
        row[column["log_words"]] = np.log1p(n)
        row[column["word_length"]] = own_size.mean()
        row[column["longest_word"]] = own_size.max()
        _, times = np.unique(own, return_counts=True)
        row[column["distinct"]] = len(times) / np.sqrt(n)
        row[column["commonest"]] = times.max() / n
        row[column["short_words"]] = (own_size <= 3).mean()
        row[column["words_in_line"]] = n / (seen[10] + 1)
        row[column["repeated_lines"]] = repeated_lines(text) / (seen[10] + 1)
        row[column["repeated_words"]] = repeated_words(own) / n
    return out


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of ordered bins with these gradients and weights, and the bins before it."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE)
    gain = np.where((left_h >= MIN_WEIGHT) & (right_h >= MIN_WEIGHT), gain - g.sum() ** 2 / (h.sum() + RIDGE), -1.0)
    if not len(gain) or gain.max() <= 0:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The addend of each bin by a tree of so many levels."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate((_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the addends of a tree that cuts one axis and then the other on either side."""
    best, table = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            found, gain = np.zeros(a.shape), 0.0
            for part in (slice(0, at), slice(at, None)):
                row_g, row_h = a[part].sum(axis=0), b[part].sum(axis=0)
                found[part] = _tree(row_g, row_h, 1)
                gain += _best_cut(row_g, row_h)[0] + row_g.sum() ** 2 / (row_h.sum() + RIDGE)
            gain -= a.sum() ** 2 / (b.sum() + RIDGE)
            if gain > best:
                best, table = gain, found.T.copy() if turned else found
    return best, table


@dataclass
class Gam:
    """Borders of the bins of each feature, tables of addends, and pairs with their borders and tables."""

    start: float = 0.0
    borders: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of features."""
        total = np.full(len(x), self.start)
        for f, (borders, table) in enumerate(zip(self.borders, self.tables, strict=True)):
            total += table[np.searchsorted(borders, x[:, f], side="right")]
        for f, k, table in self.pairs:
            total += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[k], x[:, k], side="right")]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model of labels 0 and 1. Without rows of both labels every score is the share of label 1, or 0.5."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    cuts = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1], method="higher"))
    for f in range(x.shape[1]):
        # zero and the rest are kept apart, also where most values are zero
        some = x[x[:, f] > 0, f]
        extra = cuts(some, BINS // 4) if len(some) else np.zeros(0)
        model.borders.append(np.unique(np.concatenate((cuts(x[:, f], BINS), extra))))
        few = cuts(some, PAIR_BINS // 2) if len(some) else np.zeros(0)
        model.coarse.append(np.unique(np.concatenate((cuts(x[:, f], PAIR_BINS // 2), few))))
    bins = [np.searchsorted(b, x[:, f], side="right") for f, b in enumerate(model.borders)]
    model.tables = [np.zeros(len(b) + 1) for b in model.borders]
    total = np.full(len(y), model.start)

    def left_over() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, own in enumerate(bins):
            n = len(model.tables[f])
            g, h = left_over()
            step = RATE * _tree(np.bincount(own, g, n), np.bincount(own, h, n))
            model.tables[f] += step
            total += step[own]
    coarse = [np.searchsorted(b, x[:, f], side="right") for f, b in enumerate(model.coarse)]

    def square(f: int, k: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[f]) + 1, len(model.coarse[k]) + 1
        return np.bincount(coarse[f] * shape[1] + coarse[k], values, shape[0] * shape[1]).reshape(shape)

    g, h = left_over()
    gains = [(_pair_tree(square(f, k, g), square(f, k, h))[0], f, k) for f, k in combinations(range(x.shape[1]), 2)]
    chosen = [(f, k) for gain, f, k in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    squares = {p: np.zeros((len(model.coarse[p[0]]) + 1, len(model.coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for f, k in chosen:
            g, h = left_over()
            step = RATE * _pair_tree(square(f, k, g), square(f, k, h))[1]
            squares[f, k] += step
            total += step[coarse[f], coarse[k]]
    model.pairs = [(f, k, squares[f, k]) for f, k in chosen]
    return model


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>): the features of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = measure(as_bytes(batch.column(1)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_tasks(rows, run, "id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Gam:
    """A model from the labelled documents that ``learn`` (of the id) admits, at most ``sample`` of them.

    Labels other than 0 and 1 are left out; an id with several labels counts by the least, and one with several
    documents by the least of their features.
    """
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn)
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("double").alias("__label"))
    rows = rows.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    chosen = F.broadcast(rows.select("__id"))  # at most ``sample`` ids
    found = features(docs.join(chosen, docs[id_col] == chosen["__id"], "left_semi"), id_col, text_col)
    found = found.groupBy("id").agg(F.min("x").alias("x")).join(F.broadcast(rows), F.col("id") == F.col("__id"))
    got = found.select("__id", "__label", "x").toArrow().sort_by([("__id", "ascending")])
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["__id"].to_numpy()))
    return fit(x[order], got["__label"].to_numpy()[order])


def classify(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) per row of ``docs``; a null text counts as empty. Other columns are not looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            score = sent.value.score(measure(as_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_tasks(rows, run, "id long, score double, predicted int")


def keep(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted as good, with their columns, judged where they are read. Rows with a null id stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            score = sent.value.score(measure(as_bytes(batch.column(at))))
            yield batch.filter(pa.array(score >= threshold))

    return in_tasks(docs, run, docs.schema)
