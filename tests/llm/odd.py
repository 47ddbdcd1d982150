"""Shared fixtures; test modules import them."""

import pytest
from pyspark.sql import Row

LONG = "wörter und noch mehr Wörter sind hier zu lesen " * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, "one two three four", "en", "a"),
        (1, "one two three four", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (None, "one two three four", "de", None),
        (4, LONG, "de", "b"),
        (5, "  \n\t ", None, "b"),
        (6, "12 34 !! ##", "en", "b"),
        (7, "one two three four", "en", "b"),
        (8, "x", "en", None),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame([Row(*r) for r in rows], schema)
    clash = ["row", "score", "fp", "shard", "slot", "rate", "cdf", "kept", "n_words", "id", "leader", "part", "place", "limit_lang"]
    return df.selectExpr("*", *[f"'extra' AS {c}" for c in clash], "CAST(length(text) AS LONG) AS n_chars")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
