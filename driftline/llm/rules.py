"""Quality rules: fixed rules on words and lines, and bands of n-gram perplexity for each language.

The model of a language is counted by Spark over all documents: tasks count the character n-grams of the words
they met and emit each once, Spark adds them up and derives the continuation counts of the lower orders. Every
language has a model of its own. ``LANGS`` of them are held at a time, those with the most symbols first; if there are more,
what is known of the blocks so far is written with the texts and these are read once for each such number of languages.

A text is read in blocks of ``BLOCK`` words, and each block by the model that finds it likeliest, so a passage in
another language than the declared one counts by its own; the language of a text is the one of most of its
symbols. Its bits per symbol, the logarithm of its perplexity, may lie ``BELOW`` or ``ABOVE`` spreads under or over
the median of its language. The spread is taken from the distances to the median, times the root of the length,
of all documents of the language that pass the fixed rules: a short text may lie further from the median. Text in
capitals or with few different letters lies below the band, text full of signs above it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from driftline.llm.common import as_bytes, in_tasks, slices, written
from driftline.llm.kneser_ney import BITS, ORDER, Model, grams, score

#: Languages whose models are held at a time.
LANGS = 16
MIN_WORDS = 50
MOST_REPEATED = 50
BLOCK = 32
#: Spreads that the bits per symbol may lie under and over the median, and the distance that is always allowed.
BELOW, ABOVE, ALLOWED = 6.0, 14.0, 0.05
SYMBOL = re.compile(rb"[#*$%&|<>]")


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.split())


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more; ``ids`` are word numbers below 2^31."""
    if len(ids) < 4:
        return 0
    if (top := int(ids.max()) + 1) <= 1 << 21:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # three numbers do not fit: pairs are numbered first
        pairs = np.unique(ids[:-2] * top + ids[1:-1], return_inverse=True)[1]
        windows = pairs * top + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    at = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    )


def _add(have: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if have is not None:
        keys, counts = np.concatenate((have[0], keys)), np.concatenate((have[1], counts))
    found, of = np.unique(keys, return_inverse=True)
    return found, np.bincount(of, counts, len(found)).astype(np.int64)


def count_grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each character n-gram of highest order occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, 2):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                words.setdefault(lang, Counter()).update(text.split())
            for lang, counted in words.items():
                keys, of, _ = grams(list(counted))
                times = np.fromiter(counted.values(), np.int64, len(counted))
                held[lang] = _add(held.get(lang), keys, times[of] if len(times) else times)
            if len(held) > 4 * LANGS:
                yield from _emit(held)
                held = {}
        yield from _emit(held)

    def _emit(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n)], ["lang", "gram", "n"])

    counted = in_tasks(_rows(docs, id_col, text_col, lang_col), run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def languages(counted: DataFrame) -> list[list[str]]:
    """All languages, in the parts whose models are held at a time: '' for texts without one, and those with most symbols first."""
    sums = counted.filter("lang <> ''").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang")
    langs = [r["lang"] for r in sums.select("lang").collect()]
    return [["", *langs[:LANGS]], *(langs[i : i + LANGS] for i in range(LANGS, len(langs), LANGS))]


def fit(counted: DataFrame, langs: list[str]) -> dict[str, Model]:
    """A model for each of the languages.

    What reaches the driver is bounded by the number of symbols and of these languages, not by the corpus.
    """
    levels = [counted.filter(F.col("lang").isin(langs))]
    for order in range(ORDER - 1, 0, -1):
        first = F.shiftright("gram", BITS * (order - 1))
        value = F.when(first == 0, F.col("s")).otherwise(F.col("c"))
        shorter = levels[0].select("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("gram"), "n")
        levels.insert(0, shorter.groupBy("lang", "gram").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c")).select("lang", "gram", value.alias("n")))
    tables = [df.toArrow() for df in levels]
    models = {}
    for lang in langs:
        parts = []
        for t in tables:
            t = t.filter(pc.equal(t["lang"], lang))
            gram, n = t["gram"].to_numpy(), t["n"].to_numpy()
            order = np.argsort(gram)
            parts.append((gram[order], n[order]))
        models[lang] = Model(parts)
    return models


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the blocks of texts of so many words, and the text of each block."""
    blocks = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), blocks)
    starts = np.cumsum(counts) - counts
    within = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return starts[text] + BLOCK * within, text


class _Words(NamedTuple):
    """The distinct words of texts, the numbers of all words in order, and how many a text has."""

    words: list[bytes]
    ids: np.ndarray
    counts: np.ndarray


def _words(texts: Sequence[bytes]) -> _Words:
    cut = [t.split() for t in texts]
    words = list(set().union(*cut))
    number = dict(zip(words, range(len(words)), strict=True))
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    return _Words(words, np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum())), counts)


def _likeliest(found: _Words, models: list[Model], first: int, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most that a model makes of each block, the number of the first one that does, and the code points of the words.

    The models are numbered from ``first`` on; what those before them made of the blocks is in ``batch``."""
    of_word, chars = score(found.words, models)
    if not len(found.ids):
        return np.zeros(0), np.zeros(0, np.int64), chars
    starts, _ = _blocks(found.counts)
    by_block = np.stack([np.add.reduceat(of_word[:, m][found.ids].astype(np.float64), starts) for m in range(len(models))], axis=1)
    who = by_block.argmax(axis=1)
    most = by_block[np.arange(len(who)), who]
    who = who + first
    if first:
        before, by = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("__most", "__who"))
        who = np.where(most > before, who, by)
        most = np.maximum(most, before)
    return most, who, chars


def compare(rows: DataFrame, first: int, models: dict[str, Model], text_col: str = "text") -> DataFrame:
    """The rows with the most that a model so far makes of each of their blocks, ``__most``, and its number, ``__who``.

    ``models`` are numbered from ``first`` on."""
    sent = rows.sparkSession.sparkContext.broadcast(list(models.values()))
    at = rows.columns.index(text_col)
    kept = [c for c in rows.columns if c not in ("__most", "__who")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = _words(as_bytes(batch.column(at)))
            most, who, _ = _likeliest(found, sent.value, first, batch)
            ends = pa.array(np.concatenate(([0], np.cumsum(-(-found.counts // BLOCK)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(most)), pa.ListArray.from_arrays(ends, pa.array(who.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *lists], [*kept, "__most", "__who"])

    known = StructType.fromDDL("__most array<double>, __who array<int>")
    return in_tasks(rows, run, StructType([*(rows.schema[c] for c in kept), *known.fields]))


def _mostly(text: np.ndarray, who: np.ndarray, symbols: np.ndarray, texts: int, langs: int) -> np.ndarray:
    """The language of most symbols of each text, the first of several and of none."""
    pairs, of = np.unique(text * langs + who, return_inverse=True)
    sums = np.bincount(of, symbols, len(pairs))
    own, lang = pairs // langs, pairs % langs
    order = np.lexsort((lang, -sums, own))
    found, at = np.unique(own[order], return_index=True)
    out = np.zeros(texts, np.int64)
    out[found] = lang[order][at]
    return out


MEASURES = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double, length long"


def measure(rows: DataFrame, langs: list[str], first: int, models: dict[str, Model], text_col: str = "text") -> DataFrame:
    """The rows with a struct ``__measured`` of: lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    bits and length.

    ``lang`` is the language found; ``bits`` is the mean of -log2 of the probability of a symbol, its power of two
    the perplexity; ``length`` is the number of symbols. A text without words has null bits. ``models`` are the last of
    ``langs``, from place ``first`` on; the rows know from ``compare`` what those before them say.
    """
    sent = rows.sparkSession.sparkContext.broadcast((langs, list(models.values())))
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array(sent.value[0])
        for batch in slices(batches, at):
            texts = as_bytes(batch.column(at))
            found = _words(texts)
            counts, ids = found.counts, found.ids
            most, who, chars = _likeliest(found, sent.value[1], first, batch)
            borders = np.concatenate(([0], np.cumsum(counts)))
            word_chars = np.diff(np.concatenate(([0], np.cumsum(chars[ids])))[borders])
            lengths = word_chars + counts  # the end of a word is a symbol
            logs, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            if len(ids):
                starts, text = _blocks(counts)
                np.add.at(logs, text, most)
                lang = _mostly(text, who, np.add.reduceat(chars[ids] + 1, starts), len(texts), len(langs))
            repeats = [repeated_words(ids[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
            with np.errstate(invalid="ignore", divide="ignore"):
                bits = -logs / lengths
            columns = [
                pa.array(langs[lang].tolist(), pa.string()),
                pa.array(counts),
                pa.array(word_chars),
                pa.array([len(SYMBOL.findall(t)) for t in texts], pa.int64()),
                pa.array([repeated_lines(t) for t in texts], pa.int64()),
                pa.array(repeats, pa.int64()),
                pa.array(bits, pa.float64(), mask=counts == 0),
                pa.array(lengths),
            ]
            struct = pa.StructArray.from_arrays(columns, [x.split()[0] for x in MEASURES.split(", ")])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, "__measured"])

    measured = StructType.fromDDL(MEASURES)
    return in_tasks(rows, run, StructType([*rows.schema.fields, StructField("__measured", measured)]))


def bands(measured: DataFrame) -> DataFrame:
    """(lang, median, spread) of the bits per symbol of the documents that pass the fixed rules.

    The spread is the median distance from the median, times the root of the length. One row for each language. Both are
    exact medians of rounded values, which Spark counts by value: the same in every run, and in bounded room.
    """
    passed = measured.filter("not base_failed")
    median = lambda value, digits: F.percentile(F.round(value, digits), 0.5)
    middle = passed.groupBy("lang").agg(median(F.col("bits"), 4).alias("median")).withColumnRenamed("lang", "of")
    away = F.abs(F.col("bits") - F.col("median")) * F.sqrt("length")
    return passed.join(F.broadcast(middle), passed["lang"] == middle["of"]).groupBy(F.col("lang").alias("of"), "median").agg(median(away, 2).alias("spread"))


def _judged(rows: DataFrame, counted: DataFrame, text_col: str, *drop: str) -> DataFrame:
    """The rows, without the columns to drop, with ``__measured`` and a struct ``__verdict`` of base_failed, perplexity, low, high and kept.

    What was measured is written with the rows, so that the verdict needs neither a second pass nor a shuffle.
    """
    counted = written(counted, "counted")
    parts = languages(counted)
    langs, first = list(chain.from_iterable(parts)), 0
    for part in parts[:-1]:
        rows = written(compare(rows, first, fit(counted, part), text_col), "compared")
        first += len(part)
    rows = written(measure(rows, langs, first, fit(counted, parts[-1]), text_col).drop("__most", "__who", *drop), "measured")
    m = lambda name: F.col(f"__measured.{name}")
    failed = (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > MOST_REPEATED * m("n_words"))
    measured = rows.select("__measured.*", failed.alias("base_failed"))
    away = F.col("__spread") / F.sqrt(m("length"))
    low = F.col("__median") - F.greatest(BELOW * away, F.lit(ALLOWED))
    high = F.col("__median") + F.greatest(ABOVE * away, F.lit(ALLOWED))
    kept = ~failed & F.coalesce(m("bits").between(low, high), F.lit(False))
    verdict = F.struct(failed.alias("base_failed"), F.pow(F.lit(2.0), m("bits")).alias("perplexity"), low.alias("low"), high.alias("high"), kept.alias("kept"))
    limits = bands(measured).select(F.col("of").alias("__of"), F.col("median").alias("__median"), F.col("spread").alias("__spread"))
    return rows.join(F.broadcast(limits), m("lang") == F.col("__of"), "left").withColumn("__verdict", verdict)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: (id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits, length,
    base_failed, perplexity, low, high, kept).

    A null text has no words and fails the fixed rules; texts without a language share a model. Other
    columns are not looked at. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = count_grams(docs, id_col, text_col, lang_col)
    return _judged(rows, counted, "text", "text").select("id", "__measured.*", "__verdict.*")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with their columns."""
    return _judged(docs, count_grams(docs, id_col, text_col, lang_col), text_col).filter("__verdict.kept").select(*docs.columns)
