import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must not stumble over: nulls in all columns, empty and long texts, repeats, and columns of names that clash."""
    rng = random.Random(7)
    long = " ".join(rng.choice(["ha", "ther", "on", "edé", "and"]) for _ in range(30_000))
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "  \n\t\n ", "en", "a", 5), (4, long, "en", "a", len(long)), (5, "one two three four five", "en", "a", 23), (5, "one two three four five", "en", "a", 23), (6, "one two three four five", "de", None, 23), (None, "no number here at all", "en", "a", 1), (None, None, None, None, None), (-7, "\u0000 ퟿ \U0001f600 é́ ſ K", "fr", "b", 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = {c: spark.sql(f"select {v}").columns and v for c, v in (("kept", "true"), ("start", "1L"), ("key", "'k'"), ("id", "2L"), ("f0", "3L"), ("n", "4"), ("row", "5"), ("component_id", "6L"), ("counts", "7L"), ("distance", "8.0D"))}
    return frame.selectExpr("*", *[f"{v} as {c}" for c, v in extra.items()])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
