"""Documents with everything that is awkward in them."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp long, size string, shard int, digest string, score string"

LONG = "word and more words, ever so many. " * 12_000

ROWS = [
    (1, "the same text here, and nothing else", "en", "b"), (2, "the same text here, and nothing else", "en", "a"), (3, "The same text here, and nothing else", None, "b"),
    (4, None, "en", None), (5, "", "en", "a"), (6, " \t\n ", "en", "a"), (7, "one", "fr", "c"), (7, "one", "fr", "c"), (8, "ünï ©ödé 😀 𝔘 text", "de", "b"),
    (9, LONG, "en", "a"), (None, "no identifier", "en", "b"), (10, "mail me@example.org now, or +49 30 1234567", "en", ""), (11, "x" * 50_000, "en", "c"),
    (12, "card 4111 1111 1111 1111 at 10.0.0.1", "en", "b"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, blanks, a very long text, repeated rows and ids, and further columns with names that the operators use."""
    rows = [(i, t, lang, s, len(t) if t else None, "r", 1, "2", 3, "d", "s") for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (9, 1, 0), (10, 0, 0), (None, 1, None), (8, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    """The smallest table of the driver."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
