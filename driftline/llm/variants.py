"""Spelling variants of words: neighbours at one edit, found among sorted rotations.

A word is marked with a terminator that is no letter, and all its rotations are taken. Turned so that the edited
sign comes last, two words that differ by a replaced sign agree in all but the last place, and a word that lacks the
sign is that common prefix as a whole. So every rotation is a row twice: as the prefix that skips its last sign, and
whole. Spark sorts the rows over all tasks by ranges of prefixes, and a scan meets each range of equal prefixes in
one piece. A range holds a word whole at most once and else words that differ in one sign, so it is no longer than
the alphabet, however common a word is. A sign that equals its left neighbour could be skipped in several places for
the same shorter word; only the first of such a run counts. Each member of a range gets the number of its neighbours
there and the best of them; no pairs are written.

Words are numbered in order of falling count, then code points, so the best neighbour is the one of least number and
rows need no words. Prefixes of over ``LONG`` signs are replaced by a 127-bit hash that follows from the hashes of
the word's beginnings, so that a word of any length takes rows in proportion to its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import as_bytes, in_tasks, pieces, slices, written

MIN_LENGTH, MIN_COUNT, FORM_TIMES, DROP = 6, 5, 5, 199
#: Longer prefixes are hashed.
LONG = 64
#: Distinct words that a task holds before it emits their counts.
HELD = 200_000
END = "$"
#: Latin-1: A-Z lower-cased, a-z and the letters from C0 on kept, all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_PRIME, _BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 % ((1 << 127) - 1)
_NONE = np.iinfo(np.int64).max


def runs(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters of a UTF-8 text, as Latin-1, in lists."""
    for piece in pieces(text):
        yield piece.decode().encode("latin-1", "replace").translate(_LETTERS).split()


def _result(name: bytes, run: bytes, drop: int) -> str:
    """The run, without one sign if the hash of the document's name and the run says so."""
    word = run.decode("latin-1")
    h = zlib.crc32(name + (run if run.isascii() else word.encode()))
    if h % drop:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, drop: int = DROP) -> DataFrame:
    """(word, n) of all results of at least ``min_length`` signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, 1):
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                name = b"%s:" % (b"" if key is None else str(key).encode())
                for some in runs(text):
                    # one more letter than a word has may be a word after its loss
                    for r, n in Counter(some).items():
                        if len(r) >= min_length and len(word := _result(name, r, drop)) >= min_length:
                            held[word] += n
                    if len(held) >= HELD:
                        yield out()
                        held.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_tasks(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(word: str, longest: int = LONG) -> tuple[list[str], list[str]]:
    """For a word: the rotations without their last sign, one per sign of the word; and the whole rotations, one per cut."""
    m = len(word)
    if m < longest:
        twice = word + END + word
        return [twice[i + 1 : i + 1 + m] for i in range(m)], [twice[i : i + m + 1] for i in range(m + 1)]
    twice = word + END + word
    sums, powers = [0], [1]
    for c in twice:
        sums.append((sums[-1] * _BASE + ord(c)) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)

    def key(start: int, size: int) -> str:
        if size <= longest:
            return twice[start : start + size]
        return f"#{size}#{(sums[start + size] - sums[start] * powers[size]) % _PRIME:032x}"

    return [key(i + 1, m) for i in range(m)], [key(i, m + 1) for i in range(m + 1)]


#: Roles of a row in a range of equal prefixes.
WHOLE, FIRST, AGAIN = 0, 1, 2


def rotations(words: DataFrame, longest: int = LONG) -> DataFrame:
    """(prefix, place, role) of words (place, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 17):
            keys, places, roles = [], [], []
            for place, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                skipped, whole = prefixes(word, longest)
                keys += skipped
                keys += whole
                places.append(np.full(len(skipped) + len(whole), place))
                roles += [AGAIN if i and word[i - 1] == c else FIRST for i, c in enumerate(word)]
                roles += [WHOLE] * len(whole)
                if len(keys) > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(places)), pa.array(roles, pa.int8())], ["prefix", "place", "role"])
                    keys, places, roles = [], [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(places)), pa.array(roles, pa.int8())], ["prefix", "place", "role"])

    return in_tasks(words.select("place", "word"), run, "prefix string, place long, role byte")


def _scan(prefix: pa.Array, place: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
    """(place, near, best) of each row with a neighbour in its range of equal prefixes; ranges are whole."""
    new = np.concatenate(([True], pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)))
    starts = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    skips, first = role != WHOLE, role == FIRST
    total = lambda some: np.add.reduceat(some.astype(np.int64), starts)[of]
    least = lambda some: np.minimum.reduceat(np.where(some, place, _NONE), starts)[of]
    n_skips, n_first, has_whole = total(skips), total(first), total(~skips)
    top = least(skips)
    second = least(skips & (place != top))
    other = np.where(place == top, second, top)
    near = np.where(skips, n_skips - 1 + (first & (has_whole > 0)), n_first)
    best = np.where(skips, np.where(first, np.minimum(other, least(~skips)), other), least(first))
    has = near > 0
    return pa.RecordBatch.from_arrays([pa.array(place[has]), pa.array(near[has]), pa.array(best[has])], ["place", "near", "best"])


def neighbours(rows: DataFrame) -> DataFrame:
    """(place, near, best): the number and the least place of the neighbours of each place that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last range of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            prefix = table["prefix"].chunk(0)
            last = pc.index(prefix, prefix[-1]).as_py()
            if last:
                yield _scan(prefix[:last], table["place"].to_numpy()[:last], table["role"].to_numpy()[:last])
            rest = table.slice(last).to_batches()[0]
        if rest is not None:
            yield _scan(rest.column(0), rest.column(1).to_numpy(), rest.column(2).to_numpy())

    ordered = rows.repartitionByRange("prefix").sortWithinPartitions("prefix")
    return in_tasks(ordered, run, "place long, near long, best long").groupBy("place").agg(F.sum("near").alias("near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(place, root): the end of the way of forms (place, form) from each place that has a form.

    Each round doubles the steps taken. A way has less than 64 steps, for counts grow at least by a factor on each.
    """
    at = forms.select("place", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("place").alias("root"), F.col("root").alias("next"))
        further = at.join(on, "root", "left").select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = written(further, "variants-roots")
        at = further.select("place", "root")
        if further.filter("moved").isEmpty():
            return at


def group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    form_times: int = FORM_TIMES,
    drop: int = DROP,
    longest: int = LONG,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts that is long and frequent enough.

    A null text has no words; a null id counts as an empty name in the hash that decides which runs lose a sign. Rows
    that repeat count each time. Other columns are not looked at. Empty tables give no rows.
    """
    if form_times < 2:
        raise ValueError("a form must occur at least twice as often as the word")
    counted = word_counts(docs, id_col, text_col, min_length, drop).filter(F.col("n") >= min_count)
    counted = written(counted, "variants-counts")  # sorting by ranges reads it twice
    # numbers rise with the order of the sort; they need not be consecutive
    ordered = counted.repartitionByRange(F.desc("n"), F.asc("word")).sortWithinPartitions(F.desc("n"), F.asc("word"))
    words = written(ordered.withColumn("place", F.monotonically_increasing_id()), "variants-words")
    near = neighbours(written(rotations(words, longest), "variants-rotations"))
    best = words.select(F.col("place").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = words.join(near, "place", "left").join(best, "best", "left")
    has = F.col("form_n") >= form_times * F.col("n")
    found = found.select(
        "place",
        "word",
        "n",
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best")).alias("best"),
        F.when(has, F.col("form")).alias("form"),
        F.when(has, F.col("form_n")).alias("form_n"),
    )
    found = written(found, "variants-forms")
    ends = roots(found.filter("best is not null").select("place", F.col("best").alias("form")))
    names = words.select(F.col("place").alias("root"), F.col("word").alias("root_word"))
    found = found.join(ends.join(names, "root"), "place", "left")
    return found.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
