"""Language identification by rank-order profiles.

The n-grams of one to ``ORDER`` signs of a text's words, each word with a space on either side, are ranked by how
often they occur, equal counts by code points; the ``K`` first make a profile. A language's profile is ranked in the
same way from the counts over all documents that are learned from. The distance of a document to a language sums
over the n-grams of its profile how many places each is out of place; one that the language's profile lacks counts
``K``. The nearest language wins, equal ones by code points, and the score is one minus the share of the greatest
possible distance.

Tasks count words first, since n-grams follow from distinct words, and Spark adds up the counts of n-grams. The
profiles of ``LANGS`` languages at most go to the tasks at a time; if there are more, the documents' profiles are
written and read once for each such block of languages, with the same result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import as_bytes, in_tasks, pieces, slices, written

ORDER, K = 3, 400
LANGS = 256
#: Distinct words that a task holds before it emits the counts of their n-grams.
HELD = 200_000
_WORD, _LETTER = regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"\p{L}")
#: Three signs of 21 bits fit a number whose order is that of the texts; shorter ones are filled with zeros.
_SHIFTS = (42, 21, 0)


#: Latin-1 with a space for all that is no letter.
_LATIN = bytes(c if _LETTER.match(chr(c)) else 32 for c in range(256))


def _cut(text: str) -> list[str]:
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def words(text: bytes) -> Counter:
    """How often each lower-cased word of letters and marks occurs; empty if there is no letter."""
    found: Counter = Counter()
    for piece in pieces(text):
        found.update(_cut(piece.decode().lower()))
    return found if any(map(_LETTER.search, found)) else Counter()


def grams(found: Counter, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of counted words, of up to ``order`` signs (three at most), as rising numbers, and their counts."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = " " + " ".join(found) + " "
    signs = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64)
    space = signs == 32
    times = np.fromiter(found.values(), np.int64, len(found))
    # the word of each sign; a space belongs to the word behind it, so that a pair's first sign tells its word
    of = np.cumsum(space) - 1
    keys, counts = [], []
    for n in range(1, order + 1):
        size = len(signs) - n + 1
        key = sum(signs[i : i + size] << _SHIFTS[i] for i in range(n))
        # the sign that tells the word, and must be none of the spaces: the last but one, or in pairs either
        middle = max(0, n - 2)
        inside = np.ones(size, bool) if n == 2 else ~space[middle : middle + size]
        keys.append(key[inside])
        counts.append(times[of[middle : middle + size][inside]])
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, counts, len(distinct)).astype(np.int64)


def ranked(found: Counter, order: int = ORDER, k: int = K) -> np.ndarray:
    """The ``k`` most frequent n-grams, most frequent first, equal ones rising."""
    keys, counts = grams(found, order)
    return keys[np.argsort(-counts, kind="stable")[:k]]


def learn_profiles(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, k: int = K) -> DataFrame:
    """(lang, rank, gram): the profile of every language of the documents that ``learn`` admits; ranks start at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                keys, counts = grams(found, order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                held[lang].update(words(text))
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    rows = docs.filter(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = in_tasks(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Spark limits the rows of a language in each task before it brings them together
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", place - 1).filter(F.col("rank") < k).select("lang", "rank", "gram")


class Nearest:
    """The nearest language of profiles of documents, among some languages."""

    def __init__(self, langs: list[str], profiles: list[np.ndarray], k: int = K):
        self.langs, self.k = langs, k
        self.grams = np.unique(np.concatenate(profiles)) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.grams), len(langs)), -1, np.int32)
        for i, p in enumerate(profiles):
            self.ranks[np.searchsorted(self.grams, p), i] = np.arange(len(p))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """How far a document's ranked n-grams are out of place in each language."""
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == own
        there = self.ranks[at[known]]
        out = np.where(there < 0, self.k, np.abs(there - np.flatnonzero(known)[:, None]))
        return out.sum(axis=0, dtype=np.int64) + self.k * int((~known).sum())


def _profiles(batches: Iterator[pa.RecordBatch], order: int, k: int) -> Iterator[pa.RecordBatch]:
    """(id, grams, away, lang) of (id, text), without a language yet."""
    for batch in slices(batches, 1):
        own = [ranked(words(text), order, k) for text in as_bytes(batch.column(1))]
        ends = np.cumsum([0] + [len(x) for x in own]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
        none = [None] * batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(none, pa.int64()), pa.array(none, pa.string())], _NAMES)


_NAMES = ["id", "grams", "away", "lang"]
_ROWS = "id long, grams array<long>, away long, lang string"


def _nearer(batches: Iterator[pa.RecordBatch], nearest: Nearest) -> Iterator[pa.RecordBatch]:
    """The rows with the nearest language, where it is nearer than the one they have."""
    for batch in batches:
        lists = batch.column(1)
        borders, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        away, langs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i in range(batch.num_rows):
            own = flat[borders[i] : borders[i + 1]]
            if not len(own) or not nearest.langs:
                continue
            found = nearest.distances(own)
            best = int(found.argmin())
            if away[i] is None or (int(found[best]), nearest.langs[best]) < (away[i], langs[i]):
                away[i], langs[i] = int(found[best]), nearest.langs[best]
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(away, pa.int64()), pa.array(langs, pa.string())], _NAMES)


def identify(
    docs: DataFrame,
    profiles: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    k: int = K,
    langs_at_once: int = LANGS,
) -> DataFrame:
    """(id, lang_pred, score) per row of ``docs`` by the profiles (lang, rank, gram) of languages.

    A null text, one without a letter, and any text if no language was learned get ``und`` and score 0. Rows that
    repeat are judged each; other columns are not looked at.
    """
    profiles = written(profiles, "rank-profiles")
    blocks = max(1, math.ceil(profiles.filter("rank = 0").count() / langs_at_once))
    rows, first = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), True
    for b in range(blocks):
        # the profiles of about ``langs_at_once`` languages
        some = profiles.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
        own: dict[str, list[int]] = defaultdict(list)
        for lang, gram in zip(some["lang"].to_pylist(), some["gram"].to_pylist(), strict=True):
            own[lang].append(gram)
        langs = sorted(own)
        sent = docs.sparkSession.sparkContext.broadcast((langs, [np.array(own[x], np.int64) for x in langs]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first) -> Iterator[pa.RecordBatch]:
            yield from _nearer(_profiles(batches, order, k) if first else batches, Nearest(*sent.value, k))

        rows, first = in_tasks(rows, run, _ROWS), False
        if blocks > 1:
            rows = written(rows, "rank-documents")
    score = F.coalesce(1 - F.col("away") / (F.lit(k) * F.size("grams")), F.lit(0.0))
    return rows.select("id", F.coalesce("lang", F.lit("und")).alias("lang_pred"), score.alias("score"))
