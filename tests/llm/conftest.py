import random

import pytest

from conftest_llm_words import words

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and blank texts, a very long one, ties and repeated rows."""
    rng = random.Random(4)
    long = words(rng, 30_000)
    return [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", None, 3),
        (None, "a text without an id", "en", "s", 20),
        (None, None, None, None, None),
        (4, long, "en", "s", len(long)),
        (5, "one", "en", "s", 3),
        (5, "one", "en", "s", 3),
        (6, "ünï 你好 \U0001f600 <|endoftext|> \x00 ퟿", None, "s", 10),
        (7, "a b c " * 200, "en", "s", 1200),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd rows, and extra columns whose names the operators use inside."""
    docs = spark.createDataFrame(odd_rows(), DOC)
    for name in ("fp", "rep", "mask", "key", "kept", "score", "ids", "start", "words", "digest", "y", "ends", "x", "component_id", "text_2"):
        docs = docs.selectExpr("*", f"'clash' AS {name}")
    return docs


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
