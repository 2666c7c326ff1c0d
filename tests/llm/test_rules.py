"""The bands of the quality rules and their verdict against plain medians."""

from __future__ import annotations

import random
from collections import defaultdict
from statistics import median

from pyspark.sql import functions as F

from driftline.llm import rules


def test_bands_and_verdicts_equal_plain_medians(docs):
    columns = ["id", "lang", "n_words", "n_repeat_words", "bits", "length", "base_failed", "low", "high", "kept"]
    rows = rules.judge(docs).select(*columns).collect()
    passed = defaultdict(list)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if not r.base_failed:
            passed[r.lang].append((r.bits, r.length))
    assert len(passed) >= 3
    for lang, found in passed.items():
        middle = median(round(b, 4) for b, _ in found)
        spread = median(round(abs(b - middle) * n**0.5, 2) for b, n in found)
        for r in rows:
            if r.lang == lang and r.bits is not None:
                low = middle - max(rules.BELOW * spread / r.length**0.5, rules.ALLOWED)
                high = middle + max(rules.ABOVE * spread / r.length**0.5, rules.ALLOWED)
                assert abs(r.low - low) < 1e-3 and abs(r.high - high) < 1e-3
                assert r.kept == (not r.base_failed and r.low <= r.bits <= r.high)


def test_verdicts_are_the_same_in_every_run(docs):
    again = docs.repartition(7, F.rand(3))
    verdict = lambda df: sorted((r.id, r.kept, r.low, r.high) for r in rules.judge(df).select("id", "kept", "low", "high").collect())
    assert verdict(docs) == verdict(again)


def test_every_language_has_a_model_however_many_there_are(spark, monkeypatch):
    """Twenty languages of syllables of their own, read in two passes and in one."""
    rng = random.Random(5)
    rows = []
    for n in range(20):
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
        for i in range(4):
            text = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(70 + n))
            rows.append((10 * n + i, text, f"l{n}"))
    rows += [(900, None, "l3"), (901, "", None), (902, rows[0][1] + " " + " ".join([rows[-1][1]] * 2), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    columns = ["id", "lang", "n_words", "bits", "length", "low", "high", "kept"]
    judged = lambda: sorted(map(tuple, rules.judge(docs).select(*columns).collect()))
    assert rules.LANGS < 20
    found = judged()
    assert all(r[1] == f"l{r[0] // 10}" for r in found if r[0] < 900)
    monkeypatch.setattr(rules, "LANGS", 32)
    assert judged() == found
