"""The additive model against plain versions of its features and of its sum."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import gam


def plain_features(text: bytes) -> dict[str, float]:
    words = text.split()
    out = dict.fromkeys(gam.FEATURES, 0.0)
    if not words:
        return out
    n, letters = len(words), max(1, sum(65 <= c <= 90 or 97 <= c <= 122 for c in text))
    per = lambda signs, of: sum(text.count(bytes([c])) for c in signs) / of
    lines = text.count(b"\n") + 1
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        repeated += line in seen and bool(line.split())
        seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(n - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    counts = Counter(words)
    out |= {
        "log_words": math.log1p(n), "word_length": sum(map(len, words)) / n, "longest_word": max(map(len, words)),
        "capitals": per(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", letters), "signs": per(b"#*$%&^~=+_", n), "pipes": per(b"|<>\\", n),
        "exclamations": per(b"!?", n), "digits": per(b"0123456789", n), "stops": per(b".,;:", n), "brackets": per(b"()[]{}\"'", n),
        "other_bytes": sum(c >= 128 for c in text) / len(text), "vowels": per(b"aeiouyAEIOUY", letters),
        "distinct": len(counts) / math.sqrt(n), "commonest": max(counts.values()) / n, "short_words": sum(len(w) <= 3 for w in words) / n,
        "words_in_line": n / lines, "repeated_lines": repeated / lines, "repeated_words": len(covered) / n, "links": per(b"@/", n),
    }
    return out


def plain_score(model: gam.Gam, x: list[float]) -> float:
    bin_of = lambda borders, v: sum(b <= v for b in borders)
    total = model.start + sum(table[bin_of(borders, v)] for borders, table, v in zip(model.borders, model.tables, x, strict=True))
    total += sum(table[bin_of(model.coarse[f], x[f])][bin_of(model.coarse[k], x[k])] for f, k, table in model.pairs)
    return 1 / (1 + math.exp(-total))


def test_features_equal_a_plain_count(docs, odd):
    texts = [(r.text or "").encode() for df in (docs, odd) for r in df.collect()]
    got = gam.measure(texts)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, list(plain_features(text).values()))


def test_scores_equal_a_plain_sum(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = gam.train(docs, labels, learn=F.lit(True))
    assert model.pairs and len(model.tables) == len(gam.FEATURES)
    for df in (docs, odd):
        # borders between bins are values of documents, so the last digit of a feature may decide: those of ``measure``
        rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
        want = Counter((i, round(plain_score(model, x), 9)) for (i, _), x in zip(rows, gam.measure([t for _, t in rows]).tolist(), strict=True))
        assert Counter((r.id, round(r.score, 9)) for r in gam.classify(df, model).collect()) == want


def test_training_rows_of_an_id_that_repeats(spark, sf, docs):
    """The same rows in another order, and some of them twice, give the same model."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    once = gam.train(docs, labels, learn=F.lit(True), sample=100)
    again = gam.train(docs.union(docs).union(docs).repartition(7), labels.union(labels), learn=F.lit(True), sample=100)
    assert once.start == again.start and all(np.array_equal(a, b) for a, b in zip(once.tables, again.tables, strict=True))
