"""A compact trie of word pairs: Elias-Fano levels with quantised probabilities, in one block of memory.

A level is a rising sequence of numbers. Elias-Fano keeps the low bits of each packed side by side, and the high
bits as a bit vector in which the i-th one stands at place high + i; with the number of ones before each word of
the vector, the i-th one and the i-th zero are found without a scan. All operations take arrays of queries.
"""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64
_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)


def _select_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th set bit, from 0, of each word; 64 if it has fewer."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    ones = np.cumsum(_POP[parts], axis=1, dtype=np.uint8)
    at = np.minimum((ones <= r[:, None]).sum(axis=1), 7)
    rows = np.arange(len(at))
    before = np.where(at > 0, ones[rows, np.maximum(at - 1, 0)], 0)
    inside = _SELECT[parts[rows, at], np.minimum(r - before, 7).astype(np.int64)]
    return np.where(r < ones[:, 7], at * 8 + inside, 64)


class EliasFano:
    """A rising sequence of non-negative numbers, over arrays of 64-bit words."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @staticmethod
    def pack(values: np.ndarray) -> list[np.ndarray]:
        """Header, low words, high words, and the ones before each high word."""
        values = values.astype(_U)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 2, _U)
        if bits:
            at = np.arange(n, dtype=np.int64) * bits
            part = values & _U((1 << bits) - 1)
            word, shift = at >> 6, (at & 63).astype(_U)
            np.bitwise_or.at(low, word, part << shift)
            over = (shift.astype(np.int64) + bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        places = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        size = (top >> bits) + n + 2
        flags = np.zeros((size + 63) // 64 * 64, np.uint8)
        flags[places] = 1
        high = np.packbits(flags, bitorder="little").view(_U)
        per_word = _POP[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        ones = np.concatenate(([0], np.cumsum(per_word)))[:-1]
        return [np.array([n, bits], np.int64), low, high, ones.astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(_U)
        second = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (self.low[word] >> shift | second) & _U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places, which must be there."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return (place - i).astype(_U) << _U(self.bits) | self._low(i)

    def _zero(self, r: np.ndarray) -> np.ndarray:
        """The place of the r-th zero of the bit vector, from 0; its end if there are fewer."""
        word = np.searchsorted(self.zeros, r, side="right") - 1
        inside = _select_in_word(~self.high[word], np.minimum(r - self.zeros[word], 63))
        return np.where(inside < 64, word * 64 + inside, len(self.high) * 64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is x or more; n if there is none."""
        x = x.astype(_U)
        if not self.n:
            return np.zeros(len(x), np.int64)
        wanted = x >> _U(self.bits)
        beyond = wanted >= _U(self.zeros[-1] + 64)  # more zeros than the vector can hold
        top = np.where(beyond, _U(0), wanted).astype(np.int64)
        start = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) + 1 - top, 0)
        stop = np.minimum(self._zero(top) - top, self.n)
        start = np.minimum(start, self.n)
        rest = x & _U((1 << self.bits) - 1)
        while True:
            open_ = start < stop
            if not open_.any():
                return np.where(beyond, self.n, start)
            middle = (start + stop) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self._low(middle[open_]) < rest[open_]
            start = np.where(open_ & less, middle + 1, start)
            stop = np.where(open_ & ~less, middle, stop)


#: Steps that the range of the logarithms of a level is cut into; a step is some thousandths.
STEPS = 4096


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code of 12 bits for each value, and the least value and the width of a step."""
    if not len(values):
        return np.zeros(0, np.uint16), np.zeros(2)
    least = float(values.min())
    width = (float(values.max()) - least) / (STEPS - 1) or 1.0
    return np.rint((values - least) / width).astype(np.uint16), np.array([least, width])


class PairTrie:
    """Words, the contexts among them, and for each context its successors, with codes of log10 probabilities.

    Words are numbers of 64 bits; a context is the place of its word, a successor the place of its word counted
    from the start of its context's stretch of the level. So a successor is searched for within its context only:
    the search for the first value not less than (context, word) ends between the context's two pointers or
    the pair is not there.
    """

    _PARTS = 4 * 4 + 4

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        sizes = np.frombuffer(buffer, np.int64, self._PARTS)
        at, parts = self._PARTS * 8, []
        for i, size in enumerate(sizes.tolist()):
            kind = np.int64 if i % 4 in (0, 3) else _U
            if i >= 16:
                kind = np.uint16 if i in (16, 18) else np.float64
            parts.append(np.frombuffer(buffer, kind, size // np.dtype(kind).itemsize, at))
            at += -(-size // 8) * 8
        levels = [EliasFano(int(parts[k][0]), int(parts[k][1]), *parts[k + 1 : k + 4]) for k in range(0, 16, 4)]
        self.words, self.contexts, self.pointers, self.successors = levels
        self.codes, self.values, self.weight_codes, self.weight_values = parts[16:]

    @classmethod
    def pack(cls, words: np.ndarray, context: np.ndarray, successor: np.ndarray, log: np.ndarray, weight: np.ndarray) -> bytes:
        """A block of memory from sorted words, and pairs of their places in order with their log10 probabilities;
        ``weight`` is the log10 weight of shorter contexts, for each distinct context in order."""
        distinct, first, of = np.unique(context, return_index=True, return_inverse=True)
        codes, values = quantised(log)
        weight_codes, weight_values = quantised(weight)
        parts = [
            *EliasFano.pack(words),
            *EliasFano.pack(distinct),
            *EliasFano.pack(np.concatenate((first, [len(context)]))),
            *EliasFano.pack(of.astype(_U) * _U(max(len(words), 1)) + successor.astype(_U)),
            codes,
            values,
            weight_codes,
            weight_values,
        ]
        out = [np.array([p.nbytes for p in parts], np.int64).tobytes()]
        out += [p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts]
        return b"".join(out)

    @classmethod
    def mapped(cls, block: bytes) -> PairTrie:
        """The trie in a memory map of its own, outside the heap; no file is left behind."""
        area = mmap.mmap(-1, len(block))
        area.write(block)
        return cls(area)

    def _place(self, level: EliasFano, x: np.ndarray) -> np.ndarray:
        """The places of values in a level, -1 where they are not."""
        if not level.n:
            return np.full(len(x), -1)
        at = level.successor(x)
        there = at < level.n
        there[there] = level.access(at[there]) == x[there].astype(_U)
        return np.where(there, at, -1)

    def look_up(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each word after its context, and the log10 weight of the shorter context;
        not a number for pairs, and contexts, that are not there."""
        log, weight = np.full(len(context), np.nan), np.full(len(context), np.nan)
        distinct, of = np.unique(context, return_inverse=True)
        place = self._place(self.words, distinct)
        place[place >= 0] = self._place(self.contexts, place[place >= 0])
        place = place[of]
        known = np.flatnonzero(place >= 0)
        weight[known] = self.weight_values[0] + self.weight_values[1] * self.weight_codes[place[known]]
        distinct, of = np.unique(word[known], return_inverse=True)
        successor = self._place(self.words, distinct)[of]
        known, successor = known[successor >= 0], successor[successor >= 0]
        wanted = place[known].astype(_U) * _U(max(self.words.n, 1)) + successor.astype(_U)
        at = self.successors.successor(wanted)
        inside = at < self.pointers.access(place[known] + 1).astype(np.int64) if len(known) else np.zeros(0, bool)
        known, at, wanted = known[inside], at[inside], wanted[inside]
        hit = self.successors.access(at) == wanted if len(at) else np.zeros(0, bool)
        log[known[hit]] = self.values[0] + self.values[1] * self.codes[at[hit]]
        return log, weight
