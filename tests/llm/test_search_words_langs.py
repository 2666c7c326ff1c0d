"""Ranked search, spelling variants and language identification against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from driftline.llm import rank_profiles, ranking, variants
from driftline.llm.common import fold, pieces, table
from driftline.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def test_pieces_join_to_the_text():
    for text in (b"", b"ab", b"a b\nc" * 50, b"x" * 99, b"x" * 40 + b" y\n" * 9 + b"z" * 70):
        cut = list(pieces(text, 16))
        assert b"".join(cut) == text
        assert all(p[-1:] in (b" ", b"\n") for p, q in zip(cut, cut[1:], strict=False) if q)
        assert [w for p in cut for w in p.split()] == text.split()


# -- ranked search ---------------------------------------------------------------------------------


def ranked(docs, items, k):
    """(item, rank, doc, score) by the definition, term by term."""
    cut = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    cut = [(i, Counter(x), len(x)) for i, x in cut if x]
    n_docs, n_terms = len(cut), sum(n for _, _, n in cut)
    df = Counter(t for _, x, _ in cut for t in x)
    out = []
    for item, text in set(items):
        scores = []
        for doc, tf, n in cut:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in TERM.findall((text or "").translate(LOWER))
                if tf[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(scores[:k], 1)]
    return Counter(out)


def found(df):
    return Counter((r.item_id, r["rank"], r.id, r.score) for r in df.collect())


ITEMS = [(1, "One two THREE one"), (1, "One two THREE one"), (2, None), (3, ""), (4, "nowhere"), (5, "Ünïcödé word"), (6, "a c line"), (None, "four"), (7, "word")]


def test_ranked_search(spark, sf, odd, none):
    docs = table(spark, sf, "documents")
    items = table(spark, sf, "benchmark")
    rows, asked = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    assert found(QUERIES["op11_ranked_search"](spark, sf).withColumnRenamed("doc_id", "id")) == ranked(rows, asked, 10)
    odd_items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, id long, term string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for k in (1, 2, 10):
        assert found(ranking.search(odd, odd_items, k)) == ranked(rows, ITEMS, k)
    assert ranking.search(none, odd_items).count() == ranking.search(odd, odd_items.limit(0)).count() == 0


@pytest.mark.parametrize("limit, part", [(1 << 53, 200), (40_000 * 1_000_000, 1 << 18), (1_000_000, 500)])
def test_ranked_search_in_small_tiles_and_parts(spark, monkeypatch, limit, part):
    """Ties at every place, several passes, and sums beyond the limit of exact floats."""
    for name in ("ITEMS", "DOCS", "TERMS"):
        monkeypatch.setattr(ranking, name, 7)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(rng.randrange(150), " ".join(rng.choices(words, k=rng.randrange(6)))) for _ in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)) * (50 if i == 3 else 1))) for i in range(20)]
    got = ranking.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10, part=part, limit=limit)
    assert found(got) == ranked(docs, items, 10)


def test_tiles_stay_below_the_limit():
    parts = np.array([[5, 1, 9, 2, 2], [0, 7, 1, 1, 0]])
    cut = list(ranking.tiles(parts, width=4, limit=10 * ranking.UNIT))
    assert [c for a, b, _ in cut for c in range(a, b)] == [0, 1, 2, 3, 4]
    assert all(fits == (parts[:, a:b].sum(axis=1).max() < 10) for a, b, fits in cut) and all(fits for _, _, fits in cut)
    assert [f for *_, f in ranking.tiles(np.array([[3, 12]]), limit=10 * ranking.UNIT)] == [True, False]


# -- spelling variants -----------------------------------------------------------------------------


def edits(word, letters):
    if len(word) > 100:  # the fixtures have no neighbours of such words
        return set()
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def grouped(rows, min_length=6, min_count=5, times=5, drop=199):
    seen = Counter()
    for doc, text in rows:
        for r in RUN.findall(text or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{r}".encode())
            if h % drop == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            seen[r] += 1
    n = {w: c for w, c in seen.items() if len(w) >= min_length and c >= min_count}
    letters = {c for w in n for c in w}
    near = {w: edits(w, letters) & n.keys() for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def words_of(df):
    rows = df.collect()
    assert len(rows) == len(set(rows))
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_variants(spark, sf, docs, odd, none):
    assert words_of(QUERIES["op12_spelling_variants"](spark, sf)) == grouped([(r.doc_id, r.text) for r in docs.collect()])
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert words_of(variants.group(odd, min_length=1, min_count=1, drop=3)) == grouped(rows, 1, 1, drop=3)
    assert words_of(variants.group(none)) == set()


@pytest.mark.parametrize("longest", [3, 64])
def test_variants_of_few_letters(spark, longest):
    """Runs of equal letters, where an indel fits several places, chains of forms, and hashed prefixes."""
    rng = random.Random(5)
    words = ["".join(rng.choices("aabé", k=rng.randrange(1, 8))) for _ in range(300)]
    counts = {w: rng.choice([1, 1, 2, 5, 6, 30, 150]) for w in words}
    text = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(counts.items())]
    df = spark.createDataFrame(text, "doc_id long, text string")
    got = words_of(variants.group(df, min_length=1, min_count=1, form_times=5, drop=7, longest=longest))
    assert got == grouped(text, 1, 1, drop=7)
    assert any(r != (f or w) for w, f, r, *_ in got)


def test_long_words_cost_their_length(spark):
    long = "ab" * 20_000
    rows = [(1, f"{long} {long}x {long[:9]}y{long[10:]} {long[1:]} {'b' * 64} {'b' * 65} {'b' * 63}c")]
    got = {r.word: r.n_near for r in variants.group(spark.createDataFrame(rows, "doc_id long, text string"), min_count=1, drop=1 << 40).collect()}
    assert got == {long: 3, long + "x": 1, long[:9] + "y" + long[10:]: 1, long[1:]: 1, "b" * 64: 2, "b" * 65: 1, "b" * 63 + "c": 1}
    skipped, whole = variants.prefixes("x" * 100)
    assert len(skipped) == 100 and len(whole) == 101 and len(set(skipped) | set(whole)) > 100


# -- language identification -----------------------------------------------------------------------


def profile(texts, k=400):
    seen = Counter()
    for text in texts:
        if not regex.search(r"\p{L}", text):
            continue
        for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()):
            w = f" {w} "
            seen.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    return sorted(seen, key=lambda g: (-seen[g], g))[:k]


def predicted(rows, learned, k=400):
    out = Counter()
    places = {lang: {g: i for i, g in enumerate(p)} for lang, p in learned.items()}
    for doc, text in rows:
        own = profile([text or ""], k)
        if not own or not learned:
            out[doc, "und", 0.0] += 1
            continue
        away = {lang: sum(abs(i - at[g]) if g in at else k for i, g in enumerate(own)) for lang, at in places.items()}
        best = min(away, key=lambda x: (away[x], x))
        out[doc, best, 1 - away[best] / (k * len(own))] += 1
    return out


def learned_of(rows, k=400):
    texts = defaultdict(list)
    for doc, text, lang in rows:
        if lang is not None and (doc is None or zlib.crc32(str(doc).encode()) % 4 != 2):
            texts[lang].append(text or "")
    return {lang: p for lang, t in texts.items() if (p := profile(t, k))}


def test_language_id(spark, sf, docs, odd, none):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = QUERIES["op13_language_id"](spark, sf).collect()
    learned = learned_of(rows)
    assert Counter((r.doc_id, r.lang_pred, r.score) for r in got) == predicted([r[:2] for r in rows], learned)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    odd_rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    for learn_from, learned in ((docs, learned), (odd, learned_of(odd_rows)), (none, {})):
        profiles = rank_profiles.learn_profiles(learn_from, learn=fold("doc_id", 4) != 2)
        want = predicted([r[:2] for r in odd_rows], learned)
        for at_once in (1, 256):
            found = rank_profiles.identify(odd, profiles, langs_at_once=at_once).collect()
            assert Counter((r.id, r.lang_pred, r.score) for r in found) == want
    assert rank_profiles.identify(none, profiles).count() == 0


def test_grams_of_other_scripts_and_order():
    text = "İstanbul straße ΣΟΦΟΣ नमस्ते ½ Ⅷ 日本語 \U00010400 x2y é"
    keys, counts = rank_profiles.grams(rank_profiles.words(text.encode()))
    want = Counter()
    for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()):
        w = f" {w} "
        want.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    number = lambda g: sum(ord(c) << s for c, s in zip(g, (42, 21, 0), strict=False))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {number(g): n for g, n in want.items()}
    assert sorted(want) == sorted(want, key=number)
    assert not rank_profiles.words("́ 12 !".encode()) and not rank_profiles.words(b"")


def test_counts_emitted_in_parts(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "text", "lang").limit(40)
    whole = {(r.lang, r["rank"], r.gram) for r in rank_profiles.learn_profiles(rows, F.lit(True)).collect()}
    words = {tuple(r) for r in variants.word_counts(rows).collect()}
    monkeypatch.setattr(rank_profiles, "HELD", 50)
    monkeypatch.setattr(variants, "HELD", 50)
    assert {(r.lang, r["rank"], r.gram) for r in rank_profiles.learn_profiles(rows, F.lit(True)).collect()} == whole
    assert {tuple(r) for r in variants.word_counts(rows).collect()} == words
