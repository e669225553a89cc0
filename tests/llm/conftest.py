from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Texts that every operator here must take: nulls, empty and very long ones, ties, repeated rows, other scripts.
ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "the same words in both of these rows here",
    "the same words in both of these rows here",
    "日本語のテキスト と 😀 emoji \x01\x02",
    "word " * 30_000,
    "x" * 100_000,
    "a@b.co +1 (826) 555-4081 190.137.223.204 token = abcdef0123456789",
]


def rows_of_docs(texts):
    return [(i, t, "en", None if i % 4 == 3 else f"src{i % 3}", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, numbered from 0."""

    def make(texts):
        return spark.createDataFrame(rows_of_docs(texts), DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """The odd texts, one row twice, and one without any value."""
    rows = rows_of_docs(ODD_TEXTS)
    return [*rows, rows[5], (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    # Columns with names that operators use themselves.
    rows = [(*r, 1, "x", 2) for r in odd_rows]
    return spark.createDataFrame(rows, DOCS + ", row int, digest string, id int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
