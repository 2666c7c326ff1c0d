"""Exact token counts of every prefix by dynamic programming over a merge-based piece vocabulary.

In byte-pair encoding the last token of a text fixes the rest: the encoding of a prefix is the encoding of a
shorter prefix plus one token, and that token is the only one that ends there and stays as it is when it is
encoded together with the token before it. So a pass over the places of a text finds for each prefix its last
token, by a look at the few pieces that end there, and its number of tokens, which is the shorter prefix's
plus one. Whether two pieces stay apart is found by merging them once, and remembered.

Spaces are written as a mark and a text gets one in front. No piece goes on from another character into a mark,
nor contains a line feed or tab, so a text is cut there, and between letters and other signs if no piece holds both.
The cuts are counted on their own, and a task remembers the counts of the prefixes of each cut that it has met. The cost of a text is a look-up for each word, also where
a truncation or a budget is asked for: nothing is encoded again.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import in_tasks, slices

MARK = "▁"
#: A run of marks with what follows it up to the next mark, line feed or tab; the latter stand alone.
CUT = re.compile(f"{MARK}+[^{MARK}\n\t]*|[^{MARK}\n\t]+|[\n\t]")
#: The same with a cut between Latin letters and other signs, for vocabularies without a piece that holds both.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
FINE_CUT = re.compile(f"{MARK}+(?:[{LETTERS}]+|[^{MARK}\n\t{LETTERS}]*)|[{LETTERS}]+|[^{MARK}\n\t{LETTERS}]+|[\n\t]")
#: Cuts, and characters of cuts, that a task remembers before it starts anew.
MOST_CUTS, MOST_CHARS = 400_000, 8_000_000
#: Pairs of pieces that a task remembers.
MOST_PAIRS = 2_000_000
_NEVER = float("-inf")


class Pieces:
    """A vocabulary of pieces with merge priorities, and the prefix counts of the cuts met so far."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        if any(re.search(f"[^{MARK}]{MARK}|[\n\t]", p) for p in self.score):
            raise ValueError("pieces that go on into a mark, a line feed or a tab cannot be counted by cuts")
        mixed = re.compile(f"[{LETTERS}][^{LETTERS}]|[^{MARK}{LETTERS}][{LETTERS}]")
        self.cut = CUT if any(map(mixed.search, self.score)) else FINE_CUT
        endings = defaultdict(set)
        for p in self.score:
            endings[p[-3:]].add(len(p))
        #: The sizes of the pieces of three characters and more by their last three, the largest first.
        self.endings = {end: tuple(sorted(n, reverse=True)) for end, n in endings.items() if len(end) == 3}
        self.sizes: dict[str, tuple[int, ...]] = {}
        self.stays: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.met: dict[str, Sequence[int]] = {}
        self.ends: dict[str, int] = {}
        self.met_chars = 0

    def cuts(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text: the best neighbours are merged, the leftmost first, while any can be."""
        parts = list(text)
        self._merge(parts, -1)
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when they are merged together."""
        parts = [*left, *right]
        return self._merge(parts, len(left) - 1) and len(parts) == 2

    def _merge(self, parts: list[str], border: int) -> bool:
        """Merges in place; False as soon as the pair number ``border`` at the outset would be merged."""
        score = self.score.get
        pairs = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == _NEVER:
                break
            at = pairs.index(best)
            if at == border:
                return False
            if at < border:
                border -= 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], _NEVER)
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], _NEVER)
        return True

    def cost(self, piece: str) -> int:
        """1, or the number of bytes of a character outside the vocabulary."""
        return 1 if piece in self.score else len(piece.encode())

    def _sizes(self, end: str) -> tuple[int, ...]:
        """The sizes of the pieces that may end with three characters."""
        found = self.sizes.get(end)
        if found is None:
            if len(self.sizes) >= MOST_PAIRS:
                self.sizes.clear()
            found = self.sizes[end] = (*self.endings.get(end, ()), *([2] if end[1:] in self.score else []), 1)
        return found

    def _go_on(self, cut: str, last: list[str], count: list[int]) -> None:
        """Extends the last pieces and the counts of the first prefixes of a cut to all of them."""
        score, stays, sizes = self.score, self.stays, self.sizes.get
        for i in range(len(last), len(cut) + 1):
            own = (sizes(end) or self._sizes(end)) if i >= 3 and (end := cut[i - 3 : i]) else range(i, 0, -1)
            for n in own:
                if n > i:
                    continue
                j = i - n
                piece = cut[j:i]
                if n > 1 and piece not in score:
                    continue
                if j:
                    key = (last[j], piece)
                    ok = stays.get(key)
                    if ok is None:
                        if len(stays) >= MOST_PAIRS:
                            stays.clear()
                        ok = stays[key] = self.apart(last[j], piece)
                else:
                    ok = self.whole.get(piece)
                    if ok is None:
                        ok = self.whole[piece] = self.merge(piece) == [piece]
                if ok:
                    last.append(piece)
                    count.append(count[j] + (1 if piece in score else self.cost(piece)))
                    break
            else:
                raise AssertionError(f"no last piece in {cut[:i]!r}")

    def learn(self, cuts: Iterable[str]) -> None:
        """Counts the prefixes of the cuts that are new. Taken in order, each goes on from what it shares with the one
        before, so that a beginning is counted once for all cuts that have it."""
        if len(self.met) > MOST_CUTS or self.met_chars > MOST_CHARS:
            self.met.clear()
            self.ends.clear()
            self.met_chars = 0
        met, ends, before = self.met, self.ends, ""
        last, count = [""], [0]
        for cut in sorted(set(cuts).difference(met)):
            shared = 0
            for x, y in zip(before, cut, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            self._go_on(cut, last, count)
            try:
                met[cut] = bytes(count)
            except ValueError:  # more than 255 tokens
                met[cut] = tuple(count)
            ends[cut] = count[-1]
            self.met_chars += len(cut)
            before = cut

    def counts(self, cuts: list[str]) -> list[Sequence[int]]:
        """The prefix counts of each cut."""
        if not self.met.keys() >= set(cuts):
            self.learn(cuts)
        return list(map(self.met.__getitem__, cuts))


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """The vocabulary of a task's process."""
    return Pieces(path)


def total(vocabulary: Pieces, text: str, limit: int) -> tuple[int, int]:
    """The number of tokens of a text, and the length of its longest prefix of at most ``limit`` tokens."""
    own = vocabulary.cuts(text)
    vocabulary.learn(own)
    return _total(vocabulary, text, own, limit)


def _total(vocabulary: Pieces, text: str, own: list[str], limit: int) -> tuple[int, int]:
    """The same for a text whose cuts are known."""
    n = sum(map(vocabulary.ends.__getitem__, own))
    if n <= limit:
        return n, len(text)
    at = tokens = 0
    for c in map(vocabulary.met.__getitem__, own):
        if tokens + c[-1] > limit:
            at += max(i for i, k in enumerate(c) if tokens + k <= limit)
            break
        at += len(c) - 1
        tokens += c[-1]
    return n, max(0, at - 1)


def every_prefix(vocabulary: Pieces, text: str) -> np.ndarray:
    """The number of tokens of each prefix of a text, by its length in code points from 0 on."""
    if not text:
        return np.zeros(1, np.int32)
    counted = vocabulary.counts(vocabulary.cuts(text))
    before = accumulate((c[-1] for c in counted), initial=0)
    parts = [np.frombuffer(c, np.uint8)[1:].astype(np.int32) + k if isinstance(c, bytes) else np.array(c[1:], np.int32) + k for c, k in zip(counted, before)]
    found = np.concatenate(parts)  # place 0 is the mark in front
    found[0] = 0
    return found


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def token_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fits): ``fits`` is the length in code points of the longest prefix of
    at most ``limit`` tokens. A null or empty text has neither bytes nor tokens. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cut = [vocabulary.cuts(t) for t in texts]
            vocabulary.learn(chain.from_iterable(cut))
            found = [_total(vocabulary, t, own, limit) for t, own in zip(texts, cut, strict=True)]
            n = np.array([x for x, _ in found], np.int64)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n), pa.array(n > limit), pa.array([x for _, x in found], pa.int64())],
                ["id", "n_bytes", "n_tokens", "over_limit", "fits"],
            )

    return in_tasks(_rows(df, id_col, text_col), run, "id long, n_bytes long, n_tokens long, over_limit boolean, fits long")


def prefix_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts array<int>): the tokens of the prefix of each length in code points, from 0 to the whole text.

    ``counts[a]`` answers what a truncation to a code points costs, the last place with at most b tokens what
    fits into a budget of b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            found = [every_prefix(pieces(path), t or "") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "counts"])

    return in_tasks(_rows(df, id_col, text_col), run, "id long, counts array<int>")
