"""Near-duplicates by SimHash, found with keys from the Golay code.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at most
two bits agree on one whole segment, and differ in at most two bits on the segment after it. That second
segment, padded to 23 bits, is hashed to the indices of the Golay codewords that it, or it with one bit
turned, decodes to: one to six of 4,096. Two words at distance two both decode, with one bit turned, to the
codeword of the word between them, so they share an index. A key is the number of the whole segment, its
bits, and one such index: 34 bits that tell apart, about sixteen keys for a fingerprint, and no link lost.

Fingerprints that share a key are joined and verified. In a bucket of more than ``PAIRS`` fingerprints pairs
would grow with the square, so its members meet at words instead: fingerprints at distance two or less are
exactly those with a common word at distance one or less, and all that share a word are linked. Each member
names its 65 words, and each word links its members to the least of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import as_bytes, in_tasks, repeats, slices, written

SHINGLE = 3
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Largest bucket whose fingerprints are compared in pairs; larger ones go by the words between.
PAIRS = 48
#: Generator of the binary Golay code of 23 bits, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: bytes) -> int:
    """A bit is 1 if set in over half the hashes of the shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, n = b" ".join(words), len(words) - SHINGLE + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            prints = np.array([fingerprint(x) for x in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_tasks(rows, run, "id long, fp long")


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The check bits of each 12 data bits, and the error of weight three or less of each syndrome."""
    check = np.array([_remainder(data << 11) for data in range(1 << 12)], np.uint32)
    errors = np.zeros(1 << 11, np.uint32)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            errors[check[error >> 11] ^ (error & 0x7FF)] = error
    return check, errors


def golay_index(words: np.ndarray, check: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """The data bits of the codeword within distance three of each word."""
    return (words ^ errors[check[words >> 11] ^ (words & 0x7FF)]) >> 11


def golay_keys(prints: np.ndarray, check: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of the fingerprints, each key of a row once."""
    rows, keys = [], []
    parts = [(prints >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    for j in range(3):
        whole, k = parts[j], (j + 1) % 3
        near = parts[k].astype(np.uint32)
        turned = np.stack([near] + [near ^ np.uint32(1 << b) for b in range(SEGMENTS[k][1])], axis=1)
        found = np.sort(golay_index(turned, check, errors), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        row, _ = np.nonzero(first)
        rows.append(row)
        keys.append((np.uint64(j) << np.uint64(34)) | (whole[row] << np.uint64(12)) | found[first].astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys)


def keyed(prints: DataFrame) -> DataFrame:
    """(key, fp) for distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check, errors = golay_tables()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key = golay_keys(fps.view(np.uint64), check, errors)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[row])], ["key", "fp"])

    return in_tasks(prints.select("fp"), run, "key long, fp long")


def links(prints: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(u, v) with u < v: pairs at distance one or two, enough of them to connect all such pairs."""
    keys = written(keyed(prints), "golay-keys")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(keys.join(buckets, "key"), "golay-buckets")
    small = shared.filter(F.col("n") <= pairs).select("key", "fp")
    other = small.select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= 2
    close = small.join(other, (small["key"] == other["key"]) & (F.col("fp") < F.col("v")) & near).select(F.col("fp").alias("u"), "v").distinct()
    crowded = shared.filter(F.col("n") > pairs).select("fp").distinct()
    turns = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    between = crowded.select("fp", F.explode(turns).alias("turn")).select("fp", F.col("fp").bitwiseXOR(F.col("turn")).alias("word"))
    centres = between.groupBy("word").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).filter("u < most")
    met = between.join(centres, "word").filter("fp > u").select("u", F.col("fp").alias("v")).distinct()
    return close.union(met)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable from each node of the edges (u, v), by alternating stars.

    Each round takes the least neighbour of every node as an aggregate and hangs the neighbours on it, first
    those above the node, then those below. A round is checkpointed. The edges are a forest of stars when a
    round leaves them as they were.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())

    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct().checkpoint()
    before = state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").filter("u < v").distinct()
        edges = small.checkpoint()
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, fp, component), the least id reachable over links of at most two bits.

    Equal fingerprints are one node, so a group of copies of any size costs one row. Documents without words
    have fingerprint zero and are linked like any other. A row with a null id stays in its component but
    never names it (a component of only such rows has a null name). Other columns are not looked at; an empty
    table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(links(nodes))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component"))
    of_print = named.join(lowest, "root").select("fp", "component")
    return prints.join(of_print, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that name their component, each id once; columns as they were. Rows with a null id go.

    The texts are shuffled once, and not sorted: the names are the smaller side and are hashed. Only where ids
    repeat do the rows of an id have to be brought together.
    """
    found = written(near_duplicates(docs, id_col, text_col), "components")
    names = found.filter(F.col("id") == F.col("component")).select(F.col("id").alias("__name"))
    kept = docs.join(names.distinct().hint("shuffle_hash"), docs[id_col] == F.col("__name"), "left_semi")
    return kept.dropDuplicates([id_col]) if repeats(names, "__name") else kept
