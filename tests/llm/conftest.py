import os

import pytest

SF = os.environ.get("QUARRY_TEST_SF", "/root/testdata/sf0.001")
WORDS = "the of and tion ing erra stone lamp river grass cloud metal paper glass house".split()


def prose(n, seed=0):
    """n words, the same for the same seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 16 & 15] if (x >> 16 & 15) < len(WORDS) else f"w{x % 997}")
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    long = prose(30_000, 5)
    rows = [
        (1, prose(50), "en", "a", 300), (2, prose(50), "en", "a", 300), (2, prose(50), "en", "a", 300), (3, None, "en", "a", 0), (4, "", None, "b", 0), (5, "  \n ", "de", None, 3),
        (6, long, "fr", "a", len(long)), (7, long + " tail", "fr", "a", len(long) + 5), (None, prose(50), "en", "a", None), (8, "x" * 100_000, "en", "a", 100_000), (9, "one two", "es", "c", 7), (10, "0 1", None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'clash' AS id", "'clash' AS class", "'clash' AS component_id", "'clash' AS score", "'clash' AS tokens", "'clash' AS w", "'clash' AS found", "'clash' AS bucket", "'clash' AS toxic")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
