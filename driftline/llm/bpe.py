"""Byte-level BPE as recursive DuckDB queries over the rows of a partition.

Tasks cut their texts into words with the tokenizer's pattern and hand the words they have not met before to an
in-process DuckDB. There a word is rows (word, place, token), its bytes at first. A recursive query joins
neighbours with the merge table (left, right, merged) and contracts the leftmost pair of least rank in each
word, until no word has a pair left. Rows of a round hold only words that still changed in it, so the result of
a word is its rows of the last round. Ids are decoded by a join with the vocabulary and an aggregation of the
bytes in order of place.

Memory is bounded by the batch: texts are taken in cuts of some megabytes and a longer one in portions of its words,
the words that a task remembers are limited in bytes, the rounds of one recursive query in rows, and ids are decoded
in windows. Words of more than ``LONG`` bytes, whose rounds would pile up, are contracted pair by pair from a heap of
ranks and places: each step looks at the two neighbours of the pair it contracts, so the time of a word grows with its
length and not with its square.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from heapq import heapify, heappop, heappush
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import in_tasks, slices

#: Bytes from which on a word is contracted from a heap instead of by a recursive query.
LONG = 2048
#: Words of a portion of a long text, and ids of a window of the decoder.
PORTION, WINDOW = 500_000, 1 << 18
#: Bytes of the texts that are encoded at a time: their words, as Python's strings, take some twenty times as much.
SLICE = 1 << 20
#: Rows of all rounds of one recursive query: at most the sum of the squares of its words' bytes.
ROUND_ROWS = 2 << 20
#: Words and bytes of words that a task remembers before it starts anew.
MOST_WORDS, MOST_BYTES = 500_000, 20 << 20

#: The words of ``rows``, contracted until no pair is left. A row knows its follower's place and token, so that a round
#: is a join with the merge table, the pair of each word with the least rank, the leftmost of these, and its contraction.
RECURSION = """
    with recursive rounds as (
        select word, place, token, coalesce(lead(place) over w, -1) as after, coalesce(lead(token) over w, -1) as follower, 0 as round
        from rows window w as (partition by word order by place)
        union all (
        with best as (
            select s.word, arg_min(struct_pack(place := s.place, after := s.after, merged := m.merged), m.merged::bigint << 32 | s.place) as b
            from rounds s join merges m on m.l = s.token and m.r = s.follower group by s.word
        ), taken as (
            select b.word, b.b.place as place, b.b.after as gone, b.b.merged as merged, n.after, n.follower
            from best b join rounds n on n.word = b.word and n.place = b.b.after
        )
        select s.word, s.place, case when s.place = t.place then t.merged else s.token end,
            case when s.place = t.place then t.after else s.after end,
            case when s.place = t.place then t.follower when s.after = t.place then t.merged else s.follower end, s.round + 1
        from rounds s join taken t on t.word = s.word where s.place <> t.gone)
    ), last as (select word, max(round) as round from rounds group by word)
    select r.word, r.token from rounds r join last l on l.word = r.word and l.round = r.round order by r.word, r.place
"""

def ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """A vocabulary as DuckDB tables, with the words met so far."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.words_of = regex.compile(pattern).findall
        self.matches = regex.compile(pattern).finditer
        vocabulary = ranks(path)
        self.whole = vocabulary
        merges = [
            (vocabulary[token[:k]], vocabulary[token[k:]], i)
            for token, i in vocabulary.items()
            for k in range(1, len(token))
            if token[:k] in vocabulary and token[k:] in vocabulary
        ]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        left, right, merged = np.array(merges or np.zeros((0, 3)), np.int32).T
        made = pa.table({"l": left, "r": right, "merged": merged})
        tokens = pa.table({"token": pa.array(vocabulary.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in vocabulary]})
        self.con.register("made", made)
        self.con.register("tokens", tokens)
        self.con.execute("create table merges as select * from made; create table vocabulary as select * from tokens")
        self.con.unregister("made")
        self.con.unregister("tokens")
        self.pairs: dict[tuple[int, int], int] = {}
        self.merges = merges
        self.byte = np.full(256, -1, np.int32)
        for b in range(256):
            self.byte[b] = vocabulary.get(bytes([b]), -1)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.met: dict[str, int] = {}
        self._forget()

    def _forget(self, but: set[str] = frozenset()) -> None:
        """``met`` numbers the words; word i has ``sizes[i]`` ids of ``pool`` from ``starts[i]`` on. Keeps the words of
        ``but``, those of the texts at hand, most of which are common."""
        kept = [w for w in but if w in self.met]
        parts = [self.pool[self.starts[i] : self.starts[i] + self.sizes[i]] for i in map(self.met.get, kept)]
        self.met = {}
        self.met_bytes = sum(map(len, kept))
        self.pool = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        if kept:
            self._keep(kept, np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)))

    def _keep(self, words: list[str], token: np.ndarray, sizes: np.ndarray) -> None:
        self.met.update(zip(words, range(len(self.met), len(self.met) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, token.astype(np.int32)])

    def _rows(self, words: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        return pa.table(
            {
                "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
                "place": (np.arange(int(sizes.sum())) - np.repeat(starts, sizes)).astype(np.int32),
                "token": self.byte[np.frombuffer(b"".join(words), np.uint8)],
            }
        )

    def _recursive(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = self._rows(words)  # noqa: F841  read by name below
        found = self.con.execute(RECURSION).fetchnumpy()
        return found["word"], found["token"]

    def _long(self, word: bytes) -> np.ndarray:
        """A word contracted pair by pair: of the pairs with the least rank the leftmost. A pair is found again by its place
        and tokens, which both must still be there."""
        if not self.pairs:
            self.pairs = {(a, b): m for a, b, m in self.merges}
        rank = self.pairs.get
        token = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(token)), -1]
        before = [-1, *range(len(token) - 1)]
        heap = [(m, i) for i, pair in enumerate(zip(token, token[1:], strict=False)) if (m := rank(pair)) is not None]
        heapify(heap)
        while heap:
            merged, i = heappop(heap)
            j = after[i]
            if j < 0 or token[i] < 0 or rank((token[i], token[j])) != merged:
                continue
            token[i], token[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (m := rank((merged, token[k]))) is not None:
                    heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := rank((token[h], merged))) is not None:
                heappush(heap, (m, h))
        return np.array([t for t in token if t >= 0], np.int32)

    def learn(self, words: set[str]) -> None:
        """Adds the ids of words that are not known yet."""
        if len(self.met) > MOST_WORDS or self.met_bytes > MOST_BYTES:
            self._forget(words)
        new = [w for w in words if w not in self.met]
        raw = [w.encode() for w in new]
        self.met_bytes += sum(map(len, raw))
        known, known_ids, short = [], [], []
        for w, b in zip(new, raw, strict=True):
            i = self.whole.get(b)
            if i is not None:
                known.append(w)
                known_ids.append(i)
            elif len(b) <= LONG:
                short.append((w, b))
            else:
                token = self._long(b)
                self._keep([w], token, np.array([len(token)]))
        self._keep(known, np.array(known_ids, np.int32), np.ones(len(known), np.int64))
        at = 0
        short.sort(key=lambda x: len(x[1]))
        while at < len(short):
            end, rows = at, 0
            while end < len(short) and (end == at or rows + len(short[end][1]) ** 2 <= ROUND_ROWS):
                rows += len(short[end][1]) ** 2
                end += 1
            word, token = self._recursive([b for _, b in short[at:end]])
            self._keep([w for w, _ in short[at:end]], token, np.bincount(word, minlength=end - at))
            at = end

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of each."""
        if len(texts) == 1 and len(texts[0]) > PORTION:
            found = (m.group() for m in self.matches(texts[0]))
            ids = [self._encode([words])[0] for words in iter(lambda: list(islice(found, PORTION)), [])]
            return np.concatenate(ids), np.array([sum(map(len, ids))])
        return self._encode([self.words_of(t) for t in texts])

    def _encode(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        self.learn(set().union(*cut))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        number = np.fromiter((i for words in cut for i in map(self.met.__getitem__, words)), np.int64, int(counts.sum()))
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        ids = self.pool[np.arange(int(sizes.sum())) + np.repeat(self.starts[number] - ends + sizes, sizes)]
        borders = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(borders)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of sequences of ids, given in one array; an id outside the vocabulary is an error.

        The vocabulary holds bytes as the characters of the same numbers."""
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        out: list[list[bytes]] = [[] for _ in sizes]
        for at in range(0, len(ids), WINDOW):
            own = ids[at : at + WINDOW]
            rows = pa.table({"text": text[at : at + WINDOW], "place": np.arange(len(own), dtype=np.int32), "token": own})  # noqa: F841
            found = self.con.execute(
                """select r.text, string_agg(v.bytes, '' order by r.place), count(*)
                   from rows r join vocabulary v on v.token = r.token group by r.text"""
            ).fetchall()
            if sum(n for _, _, n in found) != len(own):
                raise ValueError("an id is not in the vocabulary")
            for i, part, _ in found:
                out[i].append(part.encode("latin-1"))
        return [b"".join(parts) for parts in out]


@contextmanager
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Iterator[Codec]:
    """The codec of a task. It goes with the task: Spark uses a Python process again for quite other work."""
    held = Codec(path, pattern)
    try:
        yield held
    finally:
        held.con.close()


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids, pa.int32()))


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row; a null or empty text has no ids. Other columns are not looked at."""
    return in_tasks(_rows(df, id_col, text_col), lambda batches: _encoded(batches, path), "id long, ids array<int>")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    with codec(path) as held:
        for batch in slices(batches, 1, SLICE):
            ids = _lists(*held.encode(_texts(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) per row; null or empty ids have no bytes, an id that is unknown or null is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path) as held:
            for part in (batch.slice(at, 1000) for batch in batches for at in range(0, batch.num_rows, 1000)):
                ids = pc.fill_null(part.column(1).flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int32)
                sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.decode(ids, sizes), pa.binary())], ["id", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return in_tasks(rows, run, "id long, decoded binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary): both ways in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path) as held:
            for batch in slices(batches, 1, 4 << 20):
                ids, sizes = held.encode(_texts(batch.column(1)))
                decoded = pa.array(held.decode(ids, sizes), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, sizes), decoded], ["id", "ids", "decoded"])

    return in_tasks(_rows(df, id_col, text_col), run, "id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the rows of ``round_trip``."""
    return encoded.select(
        "id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
