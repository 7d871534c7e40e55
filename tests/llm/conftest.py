import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    long_text = "the quick brown fox jumps over the lazy dog again and again " * 2000
    rows = [(1, None), (2, ""), (3, "one"), (4, "two words"), (5, "A b c d e"), (5, "A b c d e"), (6, "a B c d e"), (None, "no id"), (None, None), (7, long_text), (8, long_text), (9, " \n\t "), (10, "é́ 日本 <|x|> \\ ### </turn>")]
    return spark.createDataFrame([(*r, 0.5, "x", 1, "y", [1]) for r in rows], "doc_id long, text string, score double, sig string, n long, fingerprint string, filters array<int>")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
