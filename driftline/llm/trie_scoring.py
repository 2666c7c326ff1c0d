"""Scoring texts with a language model whose tries are dealt over the tasks.

The model is a word pair model with absolute discounting. ``DISCOUNT`` is taken off the count of each pair, and what
a context thus loses goes to all words by their own probability; one more occurrence of the context does too. A
frequent context is dealt over several groups by classes of the word after it; its distinct followers are counted in
every group and summed by Spark first, so that its weight is the same in all groups and as if it were not dealt. It is
counted over all learned documents, and every text is scored whole. Contexts of two words would have to meet the
pairs of their last word in one place, a second exchange of all tokens; see the README for figures.

1. Tasks count the words of learned documents; Spark adds them up. The most frequent words, ``FREQUENT`` at most,
   are sent to all tasks (20 bytes each); they tell how often a context occurs, and how likely a word is.
   The words beyond are answered in two parts, what the pair has and the weight of the word's own probability;
   their counts are joined to the chunks, which add the parts up. So the model does not depend on ``FREQUENT``.
2. Tasks read the texts in chunks of some megabytes. A chunk asks for each of its distinct pairs once, with
   the number of times that it is learned; the requests are dealt by context, and by context and word where a context
   is frequent. So neither a frequent word nor a frequent pair makes a group large: it gets a request a chunk.
3. Groups count the followers of the contexts that are dealt, a row for each context and group, and get the sums.
   The task of a group adds up the counts, packs them into a trie, and answers all requests from it.
4. Answers go back to their chunk, in steps of 1 / ``ANSWER_STEPS``, and it adds them up by document.

Words are told apart by 64-bit hashes; among ten million words two are equal with a probability of 3 in a million.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import as_bytes, in_tasks, shipped, slices, written
from driftline.llm.trie import PairTrie

#: Words that all tasks know, at most; and up to which count words are told apart by it when these are chosen,
#: and the classes of each doubling beyond.
FREQUENT = 1 << 20
EXACT, CLASSES = 1 << 12, 256
#: What is taken off the count of a pair, and the occurrences of a context that are shared by all words.
DISCOUNT, SHARED = 0.75, 1.0
#: Bytes of text of a chunk, and tokens that a group of requests stands for.
CHUNK, GROUP_TOKENS = 6 << 20, 1_000_000
#: A context is dealt over groups by so many occurrences, or by this share of all tokens, which few contexts have.
SPLIT, SPLIT_SHARE = 200_000, 10_000
#: Steps of an answer for a factor of ten.
ANSWER_STEPS = 2000
#: The end of a text and its start, as words that no text holds.
END_WORD, START = b"\n", np.uint64((1 << 63) - 1)
_RARE = np.uint64(1 << 63)


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one block: each cut to the width it needs, byte by byte, compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        if a.dtype.kind == "u":
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        body = squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
        out += [np.array([len(a), len(body)], np.int64).tobytes(), a.dtype.str.encode().ljust(8), body]
    return b"".join(out)


def _unpack(block: bytes) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    out, at = [], 0
    while at < len(block):
        n, size = np.frombuffer(block, np.int64, 2, at).tolist()
        kind = np.dtype(block[at + 16 : at + 24].strip().decode())
        body = expand(block[at + 24 : at + 24 + size], max_output_size=n * kind.itemsize)
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 24 + size
    return out


@dataclass
class Words:
    """What all tasks know: the frequent words by hash with their rank and count, and sums over all learned words."""

    hashes: np.ndarray
    rank: np.ndarray
    counts: np.ndarray  # by rank
    tokens: int
    distinct: int
    texts: int
    split: int = SPLIT

    @property
    def rare(self) -> float:
        """The probability of a word that is met once, or not known."""
        return 1 / (self.tokens + 1)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of frequent words, the hash with its highest bit set of others."""
        if not len(self.hashes):
            return hashes | _RARE
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at].astype(np.uint64), hashes | _RARE)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """How often frequent words and the start occur; 0 for others."""
        out = np.where(ids == START, self.texts, 0)
        frequent = ids < len(self.counts)
        out[frequent] = self.counts[ids[frequent].astype(np.int64)]
        return out

    def parts(self, ids: np.ndarray) -> np.ndarray:
        """The number of classes of following words that each context is dealt by."""
        return 1 + self.count(ids) // max(self.split, self.tokens // SPLIT_SHARE)

    def log10(self, ids: np.ndarray) -> np.ndarray:
        """log10 of the probability of each frequent word by itself; minus infinity for others, which chunks add."""
        out = np.full(len(ids), -np.inf)
        frequent = ids < len(self.counts)
        out[frequent] = np.log10(self.counts[ids[frequent].astype(np.int64)] / (self.tokens + 1))
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A mixing function of 64 bits (its constants are fixed values of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _group(context: np.ndarray, part: np.ndarray, groups: int) -> np.ndarray:
    """The group of each context with a class of following words."""
    return (_mix(context ^ _mix(part.astype(np.uint64))) % np.uint64(groups)).astype(np.int64)


def count_words(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, n): the hash and the number of every token of the learned rows, their ends among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, chunk):
            held: Counter[bytes] = Counter()
            texts = as_bytes(batch.column(1))
            for text in texts:
                held.update(text.lower().split())
            held[END_WORD] = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(list(held)).view(np.int64)), pa.array(held.values(), pa.int64())], ["word", "n"])

    counted = in_tasks(rows.filter("learned").select("id", "text"), run, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counted: DataFrame, most: int = FREQUENT, split: int = SPLIT) -> Words:
    """The words that occur more often than so many others do that ``most`` would not hold them, and the sums."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    above = F.lit(EXACT) + F.floor(F.log2(F.col("n") / EXACT) * CLASSES)
    by_count = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(above)
    histogram = {r["k"]: r["words"] for r in counted.groupBy(by_count.alias("k")).agg(F.count(F.lit(1)).alias("words")).collect()}
    least, held = 0, 0
    for k in sorted(histogram, reverse=True):
        if held + histogram[k] > most:
            break
        held, least = held + histogram[k], k
    found = counted.filter(by_count >= least).limit(most).toArrow() if held else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    hashes, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
    by_rank = np.lexsort((hashes, -n))
    by_hash = np.argsort(hashes[by_rank])
    end = np.uint64(xxhash.xxh64_intdigest(END_WORD))
    texts = counted.filter(F.col("word") == int(end.astype(np.int64))).first()
    return Words(hashes[by_rank][by_hash], by_hash.astype(np.int32), n[by_rank], total["n"], total["v"], texts["n"] if texts else 0, split)


def _chunk(texts: list[bytes], learned: np.ndarray, known: Words, groups: int) -> tuple[list[tuple[int, bytes]], np.ndarray, list[np.ndarray]]:
    """The requests of a chunk by group, the hashes of its words that are not frequent, and what it keeps."""
    cut = [t.lower().split() for t in texts]
    words = list(set().union(*cut))
    number = dict(zip(words, range(len(words)), strict=True))
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    n, end, start = int(counts.sum()), len(words), len(words) + 1
    doc = np.repeat(np.arange(len(cut)), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    token = np.full(n + len(cut), end, np.int64)
    inside = np.ones(len(token), bool)
    inside[ends] = False
    token[inside] = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, n)
    context = np.concatenate(([start], token[:-1]))
    context[np.concatenate(([0], ends[:-1] + 1))] = start
    pair, of = np.unique(context * (start + 1) + token, return_inverse=True)
    times = np.bincount(of, learned[doc], len(pair)).astype(np.uint32)
    hashes = _hashes([*words, END_WORD])
    ids = np.concatenate((known.ids(hashes), [START]))
    left, right = pair // (start + 1), pair % (start + 1)
    parts = known.parts(ids).astype(np.uint64)[left]
    group = _group(ids[left], _mix(ids[right]) % parts, groups)
    order = np.argsort(group, kind="stable")
    borders = np.searchsorted(group[order], np.arange(groups + 1))
    requests = []
    for g in np.flatnonzero(np.diff(borders)):
        own = order[borders[g] : borders[g + 1]]
        used, place = np.unique(np.concatenate((left[own], right[own])), return_inverse=True)
        by_id = np.argsort(ids[used])
        rank = np.empty(len(used), np.int64)
        rank[by_id] = np.arange(len(used))
        place = rank[place].astype(np.uint32)
        requests.append((int(g), _pack(ids[used][by_id], place[: len(own)], place[len(own) :], times[own])))
    answer = np.empty(len(pair), np.int64)
    answer[order] = np.arange(len(pair))
    asked, docs = _by_answer(answer[of], doc, len(pair))
    is_rare = (ids[:-1] & _RARE) > 0
    scale = known.tokens + 0.5 * (known.distinct + 1)
    base = np.log10((np.where(is_rare, 0, known.count(ids[:-1])) + 0.5) / scale)
    rare_place = np.cumsum(is_rare) - 1
    to_add = is_rare[right[order]]
    added = rare_place[right[order][to_add]].astype(np.uint32)
    rare = is_rare[token]
    rare_asked, rare_docs = _by_answer(rare_place[token[rare]], doc[rare], int(is_rare.sum()))
    sums = np.bincount(doc, np.where(is_rare, 0.0, base)[token], len(cut))
    seen = np.bincount(doc, ~rare, len(cut))
    kept = [(counts + 1).astype(np.uint64), asked, docs, rare_asked, rare_docs, sums, seen.astype(np.uint64), to_add.astype(np.uint8), added]
    return requests, hashes[is_rare], kept


def _by_answer(number: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each of n answers is used, and by which document each time, in the order of the answers."""
    order = np.argsort(number, kind="stable")
    return np.bincount(number, minlength=n).astype(np.uint32), doc[order].astype(np.uint32)


def _requests(rows: DataFrame, known: Words, groups: int, size: int = CHUNK) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch in slices(batches, 1, size):
            learned = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            requests, rare, kept = _chunk(as_bytes(batch.column(1)), learned, sent.value, groups)
            for g, block in requests:
                yield pa.RecordBatch.from_pylist([{"kind": "pairs", "chunk": chunk, "part": g, "block": block, "ids": None, "learned": None, "rare": None}], schema=schema)
            own = {"kind": "own", "chunk": chunk, "part": None, "block": _pack(*kept), "ids": batch.column(0).to_pylist(), "learned": batch.column(2).to_pylist(), "rare": rare.view(np.int64).tolist()}
            yield pa.RecordBatch.from_pylist([own], schema=schema)
            chunk += 1

    schema = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("part", pa.int32()), ("block", pa.binary()), ("ids", pa.list_(pa.int64())), ("learned", pa.list_(pa.bool_())), ("rare", pa.list_(pa.int64()))])
    return in_tasks(rows.select("id", "text", "learned"), run, "kind string, chunk long, part int, block binary, ids array<long>, learned array<boolean>, rare array<long>")


def dealt(known: Words, blocks: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of a group's requests that are dealt over groups, and the number of words learned after each here."""
    found = []
    for ids, context, word, times in blocks:
        ids = ids.astype(np.uint64)
        own = np.flatnonzero((known.parts(ids) > 1)[context])
        found.append((ids[context[own]], ids[word[own]], times[own] > 0))
    context, word, learned = (np.concatenate(x) for x in zip(*found, strict=True))
    contexts, of = np.unique(context, return_inverse=True)
    words, place = np.unique(word[learned], return_inverse=True)
    pairs = np.unique(of[learned] * len(words) + place)
    return contexts, np.bincount(pairs // max(len(words), 1), minlength=len(contexts))


def _kinds(known: Words, contexts: np.ndarray, own: np.ndarray, sums: dict[int, int]) -> np.ndarray:
    """The number of distinct words after each context: its own here, the sum over all groups where it is dealt."""
    out = own.copy()
    for i in np.flatnonzero(known.parts(contexts) > 1):
        out[i] = sums[int(contexts[i])]
    return out


def build(known: Words, ids: np.ndarray, context: np.ndarray, word: np.ndarray, times: np.ndarray, sums: dict[int, int] | None = None) -> bytes:
    """The trie of the pairs of a group in order, given as places among sorted ids, with the times each is learned.

    ``sums`` has the number of distinct words after each context that is dealt over groups.
    """
    learned = times > 0
    context, word, times = context[learned], word[learned], times[learned]
    distinct, of = np.unique(context, return_inverse=True)
    total = np.where((ids[distinct] & _RARE) > 0, np.bincount(of, times, len(distinct)), known.count(ids[distinct]))
    kinds = _kinds(known, ids[distinct], np.bincount(of, minlength=len(distinct)), sums or {})
    weight = (DISCOUNT * kinds + SHARED) / (total + SHARED)
    log = np.log10((times - DISCOUNT) / (total[of] + SHARED) + weight[of] * 10.0 ** known.log10(ids[word]))
    return PairTrie.pack(ids, context, word, log, np.log10(weight))


def looked_up(known: Words, block: bytes, context: np.ndarray, word: np.ndarray, sums: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log10 of what a trie in a memory map has for each word, by id, after its context, and of the weight of the word's
    own probability; not a number for pairs that are not there. A word that is not frequent has its pair's part only."""
    log, weight = PairTrie.mapped(block).look_up(context, word)
    left = np.flatnonzero(np.isnan(weight))
    distinct, of = np.unique(context[left], return_inverse=True)
    kinds = _kinds(known, distinct, np.zeros(len(distinct), np.int64), sums or {})
    weight[left] = np.log10((DISCOUNT * kinds + SHARED) / (known.count(distinct) + SHARED))[of]
    return log, weight


def answered(known: Words, block: bytes, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 of the probability of each frequent word, by id, after its context."""
    log, weight = looked_up(known, block, context, word)
    return np.where(np.isnan(log), weight + known.log10(word), log)


def score(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    group_tokens: int = GROUP_TOKENS,
    split: int = SPLIT,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per row of ``docs``: (id, learned, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are the words, A-Z in lower case, and the end of the text. ``n_known`` are those that learned documents
    have; ``base_score`` is the log10 probability of the tokens by themselves, each count raised by a half,
    and ``score`` that of the text by the model. A null text has only its end; rows of equal ids are scored one by
    one, and rows whose ``learn`` is null are not learned. Other columns are not looked at; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    spark = docs.sparkSession
    shipped(spark)
    counted = written(count_words(rows, chunk), "word-counts")
    known = frequent_words(counted, frequent, split)
    groups = 1 + known.tokens // group_tokens
    table = written(_requests(rows, known, groups, chunk), "requests")
    sent = spark.sparkContext.broadcast(known)

    def count_dealt(group: pa.Table) -> pa.Table:
        contexts, n = dealt(sent.value, [_unpack(b.as_py()) for b in group["block"]])
        return pa.table({"part": pa.array([group["part"][0].as_py()] * len(contexts), pa.int32()), "context": contexts.view(np.int64), "n": n})

    def answer(group: pa.Table, followers: pa.Table) -> pa.Table:
        known = sent.value
        sums = dict(zip(followers["context"].to_pylist(), followers["n"].to_pylist(), strict=True))
        blocks = [_unpack(b.as_py()) for b in group["block"]]
        ids = np.unique(np.concatenate([b[0].astype(np.uint64) for b in blocks]))
        place = [np.searchsorted(ids, b[0].astype(np.uint64)) for b in blocks]
        keys = np.concatenate([p[b[1]] * len(ids) + p[b[2]] for p, b in zip(place, blocks, strict=True)])
        pairs, of = np.unique(keys, return_inverse=True)
        times = np.bincount(of, np.concatenate([b[3] for b in blocks]).astype(float), len(pairs))
        context, word = pairs // len(ids), pairs % len(ids)
        block = build(known, ids, context, word, times, sums)
        log, weight = looked_up(known, block, ids[context], ids[word], sums)
        steps = lambda x: np.rint(-ANSWER_STEPS * x).astype(np.uint32)
        to_add = (ids[word] & _RARE) > 0
        value = steps(np.where(to_add, weight, np.where(np.isnan(log), weight + known.log10(ids[word]), log)))[of]
        own = np.where(np.isnan(log), 0, 1 + steps(np.nan_to_num(log)))[of]  # 0: the pair is not there
        borders = np.cumsum([len(b[1]) for b in blocks])[:-1]
        answers = zip(*(np.split(x, borders) for x in (value, own, to_add[of])), strict=True)
        packed = [_pack(v, o[t].astype(np.uint32)) for v, o, t in answers]
        return pa.table({"chunk": group["chunk"], "part": group["part"], "block": pa.array(packed, pa.binary())})

    requests = table.filter("kind = 'pairs'").select("chunk", "part", "block")
    # Both uses of the requests share one exchange. SPLIT_SHARE bounds the contexts that are dealt, and their parts.
    kinds = requests.groupBy("part").applyInArrow(count_dealt, "part int, context long, n long")
    sums = kinds.groupBy("context").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
    followers = sums.select(F.explode("parts").alias("part"), "context", "n")
    answers = requests.groupBy("part").cogroup(followers.groupBy("part")).applyInArrow(answer, "chunk long, part int, block binary")
    kept = table.filter("kind = 'own'")
    rare = kept.select("chunk", F.posexplode("rare").alias("place", "word"))
    rare = rare.join(counted, "word").groupBy("chunk", (F.col("place") / 65536).cast("int").alias("at")).agg(F.collect_list("place").alias("place"), F.collect_list("n").alias("n"))
    nothing = lambda kind: F.lit(None).cast(kind)
    answers = answers.select("chunk", "part", "block", nothing("array<int>").alias("place"), nothing("array<long>").alias("n"))
    answers = answers.union(rare.select("chunk", nothing("int"), nothing("binary"), "place", "n"))

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        known = sent.value
        out = []
        got = got.sort_by([("part", "ascending")])
        for row in own.to_pylist():
            size, asked, docs, rare_asked, rare_docs, base, seen, to_add, added = _unpack(row["block"])
            rare = np.zeros(len(row["rare"]), np.int64)
            for place, n in zip(got["place"], got["n"], strict=True):
                if place.is_valid:
                    rare[np.asarray(place.values)] = np.asarray(n.values)
            answers = [_unpack(b) for b in got["block"].to_pylist() if b is not None]
            value, own = (np.concatenate([np.zeros(0), *(a[k] for a in answers)]) for k in (0, 1))
            value /= -ANSWER_STEPS
            to_add = to_add > 0
            pair = np.where(own > 0, 10.0 ** ((1 - own) / ANSWER_STEPS), 0)
            value[to_add] = np.log10(pair + 10.0 ** value[to_add] * np.maximum(rare[added], 1) * known.rare)
            score = np.bincount(docs, np.repeat(value, asked), len(size))
            scale = known.tokens + 0.5 * (known.distinct + 1)
            base = base + np.bincount(rare_docs, np.repeat(np.log10((rare + 0.5) / scale), rare_asked), len(size))
            seen = seen.astype(np.int64) + np.bincount(rare_docs, np.repeat(rare > 0, rare_asked), len(size)).astype(np.int64)
            out.append(
                pa.table(
                    {
                        "id": pa.array(row["ids"], pa.int64()),
                        "learned": pa.array(row["learned"], pa.bool_()),
                        "n_tokens": pa.array(size.astype(np.int64)),
                        "n_known": pa.array(seen),
                        "train_tokens": pa.array(np.full(len(size), known.tokens, np.int64)),
                        "base_score": pa.array(base),
                        "score": pa.array(score),
                    }
                )
            )
        return pa.concat_tables(out) if out else schema.empty_table()

    result = "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = pa.schema([("id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, result)
