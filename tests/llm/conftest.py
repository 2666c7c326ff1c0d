from __future__ import annotations

import pytest

LONG = "word " * 30_000 + "x" * 30_000


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    rows = [
        (1, None, "en", "a", 0, "x", 1, 0.5),
        (2, "", None, None, None, "x", None, 0.5),
        (3, " \t\n ", "en", "a", 3, None, 1, None),
        (4, LONG, "en", "b", len(LONG), "x", 1, 0.5),
        (5, "One two three four. Ünïcödé 日本語 😀 \x00 ▁", "de", "b", 9, "x", 1, 0.5),
        (5, "One two three four. Ünïcödé 日本語 😀 \x00 ▁", "de", "b", 9, "x", 1, 0.5),
        (6, "One two three four. Ünïcödé 日本語 😀 \x00 ▁", "de", "b", 9, "x", 1, 0.5),
        (None, "no id at all", "xx", None, 1, "x", 1, 0.5),
        (7, "a b c " * 40 + "\nline\nline\n", "en", "c", 1, "x", 1, 0.5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, size int, score double")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
