import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, slot int, shard string, node int, kept boolean, t string, key int, class_id int, taken int"


def _extra(i):
    return ("x", i, i, "s", i, True, "t", i, i, i)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    syllables = ["an", "the", "or", "ing", "re", "to", "é", "ß", "st"]
    return lambda n, seed=None: " ".join("".join((random.Random(f"{seed}{i}") if seed is not None else rng).choices(syllables, k=1 + (i % 3))) for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Nulls in any column, empty and very long texts, repeated rows, and columns with clashing names."""
    long = words(30000, "long")
    rows = [
        (1, words(80, "a"), "en", "s0"),
        (1, words(80, "a"), "en", "s0"),
        (2, words(80, "a"), "en", None),
        (None, words(60, "b"), None, "s1"),
        (None, None, None, None),
        (3, None, "en", "s0"),
        (4, "", "en", "s1"),
        (5, "  \n\t ", "fr", "s1"),
        (6, long, "en", "s0"),
        (7, "x" * 200000, "en", "s2"),
        (8, "one two", "en", "s2"),
        (9, "a  b \x85 c\x00 '", None, "s2"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), *_extra(i)) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
