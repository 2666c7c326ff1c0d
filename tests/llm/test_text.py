"""Encoding, token counts, rules, classifier and language model against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from contextlib import nullcontext

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken

from driftline.llm import bpe, gam, prefixes, rules, trie_scoring
from driftline.llm.common import fold, table
from driftline.llm.kneser_ney import END, Model, grams
from driftline.llm.queries import QUERIES
from driftline.llm.trie import EliasFano, PairTrie

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})


def _texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_bpe_equals_the_library(spark, sf, docs, encoding):
    want = {}
    for i, text in _texts(docs):
        ids = encoding.encode_ordinary(text)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_byte_bpe"](spark, sf).collect()}
    assert got == want


def test_bpe_of_odd_rows(odd, none, encoding):
    encoded = bpe.encode(odd, RANKS)
    assert Counter((r.id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(encoding.encode_ordinary(t))) for i, t in _texts(odd))
    assert Counter((r.id, bytes(r.decoded)) for r in bpe.decode(encoded, RANKS).collect()) == Counter((i, t.encode()) for i, t in _texts(odd))
    assert bpe.encode(none, RANKS).count() == bpe.round_trip(none, RANKS).count() == 0


def test_bpe_of_long_words(encoding):
    rng = random.Random(2)
    codec = bpe.Codec(RANKS)
    texts = ["a" * 20_000, "".join(rng.choice("ab") for _ in range(3000)), "日本語" * 1500, "the" * 900, ""]
    ids, sizes = codec.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [encoding.encode_ordinary(t) for t in texts]
    assert codec.decode(ids, sizes) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6], np.int32), np.array([1]))


def test_bpe_of_a_text_of_many_megabytes_and_a_word_of_one(encoding):
    rng = random.Random(1)
    codec = bpe.Codec(RANKS)
    text = (" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 9))) for _ in range(20_000)) + "\n") * 260
    assert len(text) > 24 << 20
    ids, sizes = codec.encode([text])
    assert codec.decode(ids, sizes) == [text.encode()] and ids.tolist() == encoding.encode_ordinary(text)
    word = "".join(rng.choices("etaoinshr", k=1_000_000))
    ids, sizes = codec.encode([word])
    assert codec.decode(ids, sizes) == [word.encode()]
    word = word[:8_000]
    assert codec.encode([word])[0].tolist() == encoding.encode_ordinary(word)


def test_bpe_decodes_across_windows(monkeypatch, encoding):
    monkeypatch.setattr(bpe, "WINDOW", 7)
    monkeypatch.setattr(bpe, "PORTION", 5)
    codec = bpe.Codec(RANKS)
    texts = ["", "日本語 and more words than one window holds", "", "x", "né" * 9]
    ids, sizes = codec.encode(texts)
    assert codec.decode(ids, sizes) == [t.encode() for t in texts]
    assert codec.encode(texts[1:2])[0].tolist() == encoding.encode_ordinary(texts[1])


def test_bpe_forgets_and_goes_on(monkeypatch, docs, encoding):
    monkeypatch.setattr(bpe, "MOST_WORDS", 500)
    codec = bpe.Codec(RANKS)
    for _, text in _texts(docs)[:40]:
        assert codec.encode([text])[0].tolist() == encoding.encode_ordinary(text)


def test_token_counts_equal_the_library(spark, sf, docs, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df, got in ((docs, QUERIES["op8_token_counts"](spark, sf)), (odd, prefixes.token_counts(odd, PIECES, 4096))):
        want = Counter((i, len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in _texts(df))
        assert Counter((r[0], r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert prefixes.token_counts(none, PIECES, 9).count() == prefixes.prefix_counts(none, PIECES).count() == 0


def test_every_prefix_is_exact(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    short = docs.selectExpr("doc_id", "substring(text, 1, 150) text").limit(20)
    texts = dict(_texts(short))
    for r in prefixes.prefix_counts(short, PIECES).collect():
        text = texts[r.id]
        assert r.counts == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        for limit in (0, 1, 7, 30):
            assert prefixes.total(prefixes.pieces(PIECES), text, limit)[1] == max(k for k, n in enumerate(r.counts) if n <= limit)
    rng = random.Random(5)
    vocabulary = list(prefixes.pieces(PIECES).score)
    for _ in range(3000):
        text = "".join(rng.choice(vocabulary) for _ in range(4)).replace(prefixes.MARK, " ")
        assert prefixes.total(prefixes.pieces(PIECES), text, 9)[0] == len(library.encode(text))


def _base(text: str) -> tuple:
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        lines += line in seen and bool(line.encode().split())
        seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), lines, len(covered), failed


def test_rules_equal_plain_counts(spark, sf, docs, odd, none):
    for df, got in ((docs, QUERIES["op6_quality_rules"](spark, sf)), (odd, rules.judge(odd))):
        rows = got.collect()
        assert Counter((r[0], r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == Counter((i, *_base(t)) for i, t in _texts(df))
        assert not any(r.base_failed and r.kept for r in rows)
    assert rules.judge(none).count() == rules.keep(none).count() == 0
    assert rules.keep(odd).columns == odd.columns


def test_repeated_words_of_many_distinct_words():
    n = 1 << 21
    assert rules.repeated_words(np.array([0, 0, n, 5, 0, 1, 0])) == 0
    assert rules.repeated_words(np.array([n, 1, n + 7, 5, n, 1, n + 7])) == 6
    assert rules.repeated_words(np.arange(2 * n)) == 0


def test_perplexity_bands(spark, sf, docs):
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in rules.judge(docs).collect() if not r.base_failed and r.id in labels]
    good = [r for r in rows if labels[r.id] == 1]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in rows if labels[r.id] == 0) > 0
    assert all(math.isclose(r.perplexity, 2**r.bits) for r in rows)


def test_kneser_ney_is_a_distribution(docs):
    words = sorted({w for _, t in _texts(docs)[:30] for w in t.encode().split()})
    packed, of, chars = grams(words)
    assert [chars[i] for i in range(len(words))] == [len(w.decode()) for w in words]
    assert (np.bincount(of) == chars + 1).all() and (packed & 31 > 0).all()
    levels = [np.unique(packed, return_counts=True)]
    for order in (3, 2, 1):
        gram, n = levels[0]
        short = gram & ((1 << 5 * order) - 1)
        found, at = np.unique(short, return_inverse=True)
        raw = np.bincount(at, n, len(found))
        levels.insert(0, (found, np.where(found >> 5 * (order - 1) == 0, raw, np.bincount(at))))
    model = Model(levels)
    for context in (0, int(packed[0]) >> 5, int(packed[50]) >> 5, 3 << 10 | 4 << 5 | 31):
        every = (context << 5) | np.arange(END, 32)
        assert abs((2.0 ** model.log2(every)).sum() - 1) < 1e-3


def test_classifier_on_held_out_rows(spark, sf, docs, odd, none):
    labels = table(spark, sf, "labels")
    rows = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, sf).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(r.quality, rows[r.doc_id]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(y == x.predicted for y, x in held) >= 0.9 * len(held)
    model = gam.train(docs, labels, fold("doc_id") != 0)
    again = gam.train(docs.repartition(7), labels.repartition(3), fold("doc_id") != 0)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True))
    assert gam.classify(odd, model).count() == odd.count()
    assert gam.keep(odd, model).columns == odd.columns
    assert gam.classify(none, model).count() == 0
    blank = gam.train(docs, labels.limit(0), fold("doc_id") != 0)
    assert {r.score for r in gam.classify(odd, blank).collect()} == {0.5}


def test_pairs_are_used():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and model.pairs


def _plain_scores(rows):
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t, _ in rows}
    learned = [i for i, _, own in rows if own]
    c = Counter(w for i in learned for w in tokens[i])
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for i in learned for p in zip([b"<s>", *tokens[i]], tokens[i], strict=False))
    before, kinds = Counter(), Counter(a for a, _ in pairs)
    for (a, _), k in pairs.items():
        before[a] += k
    out = {}
    for i, own in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        model = 0.0
        for a, b in zip([b"<s>", *own], own, strict=False):
            alone = max(c[b], 1) / (n + 1)
            model += math.log10((max(pairs[a, b] - 0.75, 0) + (0.75 * kinds[a] + 1) * alone) / (before[a] + 1))
        out[i] = (len(own), sum(c[w] > 0 for w in own), n, base, model)
    return out


def test_scores_equal_the_plain_model(spark, sf, docs):
    rows = [(r.doc_id, r.text, r.own) for r in docs.select("doc_id", "text", (fold("doc_id") != 1).alias("own")).collect()]
    want = _plain_scores(rows)
    for r in QUERIES["op4_lm_scoring"](spark, sf).collect():
        n, known, total, base, model = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and abs(r.score - model) < 2e-3 * n
    held = [r for r in QUERIES["op4_lm_scoring"](spark, sf).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_with_small_groups(spark, docs, odd, none):
    whole = {r.id: r for r in trie_scoring.score(docs, fold("doc_id") != 1).collect()}
    small = {r.id: r for r in trie_scoring.score(docs, fold("doc_id") != 1, chunk=1 << 15, group_tokens=9000).collect()}
    assert all(abs(small[i].score - r.score) < 1e-3 * r.n_tokens and small[i].n_known == r.n_known for i, r in whole.items())
    assert trie_scoring.score(odd, fold("doc_id") != 1).count() == odd.count()
    assert trie_scoring.score(odd, fold("doc_id") == 9).filter("score <> 0 or n_known > 0 or train_tokens > 0").count() == 0
    assert trie_scoring.score(none, fold("doc_id") != 1).count() == 0


@pytest.mark.parametrize("frequent", [0, 60])
def test_scores_do_not_depend_on_what_tasks_know(spark, docs, frequent):
    rows = [(r.doc_id, r.text, r.own) for r in docs.select("doc_id", "text", (fold("doc_id") != 1).alias("own")).collect()]
    want = _plain_scores(rows)
    for r in trie_scoring.score(docs, fold("doc_id") != 1, chunk=1 << 15, group_tokens=9000, frequent=frequent).collect():
        n, known, _, base, model = want[r.id]
        assert r.n_known == known and math.isclose(r.base_score, base, rel_tol=1e-9) and abs(r.score - model) < 2e-3 * n


def test_scores_do_not_depend_on_the_split(spark, docs):
    rows = [(r.doc_id, r.text, r.own) for r in docs.select("doc_id", "text", (fold("doc_id") != 1).alias("own")).collect()]
    want = _plain_scores(rows)
    for r in trie_scoring.score(docs, fold("doc_id") != 1, chunk=1 << 15, group_tokens=9000, split=30).collect():
        n, known, _, _, model = want[r.id]
        assert r.n_known == known and abs(r.score - model) < 2e-3 * n


def test_frequent_words_of_large_counts(spark):
    counted = spark.range(100).selectExpr("id word", "5000 + 100 * id n")
    known = trie_scoring.frequent_words(counted, 50)
    assert 40 <= len(known.counts) <= 50 and known.counts.tolist() == [14900 - 100 * k for k in range(len(known.counts))]


def test_model_sums_to_one_over_its_words():
    ids = np.arange(6, dtype=np.uint64)
    counts = np.array([40, 20, 10, 5, 3, 2])
    known = trie_scoring.Words(ids, ids.astype(np.int32), counts, 80, 6, 8)
    context, word, times = np.array([0, 0, 1, 3]), np.array([1, 2, 0, 0]), np.array([25.0, 15.0, 20.0, 5.0])
    block = trie_scoring.build(known, ids, context, word, times)
    for c in (0, 1, 3):
        p = 10 ** trie_scoring.answered(known, block, np.full(6, c, np.uint64), ids)
        lost = known.rare * (0.75 * (context == c).sum() + 1) / (counts[c] + 1)
        assert abs(p.sum() + lost - 1) < 2e-2


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (7, 3), (1000, 90), (1000, 10**6), (5000, 2**63), (700, 700)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        head, *parts = EliasFano.pack(values)
        level = EliasFano(int(head[0]), int(head[1]), *parts)
        assert (level.access(np.arange(n)) == values).all() if n else True
        asked = np.concatenate((rng.integers(0, top, 500, dtype=np.uint64), values, np.array([0, top, top + 9, 2**63], np.uint64)))
        assert (level.successor(asked) == np.searchsorted(values, asked)).all()


def test_trie_finds_pairs_in_their_context_only():
    words = np.array([3, 9, 2**63 + 5], np.uint64)
    trie = PairTrie.mapped(PairTrie.pack(words, np.array([0, 0, 2]), np.array([0, 2, 1]), np.array([-1.0, -2.0, -3.0]), np.array([-0.5, -0.7])))
    log, weight = trie.look_up(words[[0, 0, 0, 1, 2, 2]], words[[0, 1, 2, 0, 1, 2]])
    assert np.allclose(log, [-1, np.nan, -2, np.nan, -3, np.nan], atol=1e-3, equal_nan=True)
    assert np.allclose(weight, [-0.5, -0.5, -0.5, np.nan, -0.7, -0.7], atol=1e-3, equal_nan=True)


def test_texts_are_encoded_in_small_slices(monkeypatch):
    """Beside the executor's heap there is room for the words of a megabyte, not of a whole batch."""
    taken = []

    class Held:
        def encode(self, texts):
            taken.append(sum(map(len, texts)))
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)

    monkeypatch.setattr(bpe, "codec", lambda path: nullcontext(Held()))
    texts = ["a word " * 20_000] * 60 + [None, "b" * 3_000_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    out = [i for part in bpe._encoded(iter([batch]), "") for i in part.column(0).to_pylist()]
    assert out == list(range(len(texts))) and sum(taken) == sum(len(t or "") for t in texts)
    assert max(n for n in taken if n != 3_000_000) <= 1 << 20 and len(taken) >= 9
