import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "row string, _hash string, _len string, _id string, _text string, _group string, n_words string, copies string, copy string, score string, kept string, listed string, edits string, line string, size string"


def prose(seed, n, letters="abcdefghij"):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(letters, k=draw.randint(2, 7))) for _ in range(n))


def tricky():
    """Documents with nulls, empty, blank, very long, equal, near-equal and repeated ones, and odd white space."""
    a, b, long = prose(1, 120), prose(2, 90), prose(3, 30_000)
    words = a.split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    return [
        (1, a, "en", "s1", 1), (2, a, "en", "s1", 1), (2, a, "en", "s1", 1), (3, a.replace(" ", "\t\n "), "en", "s2", 1),
        (4, near, "en", "s2", 1), (5, b, "fr", "s3", 1), (6, None, "en", "s1", None), (7, "", None, None, 0),
        (8, " \n\t ", "en", "s1", 4), (None, b, None, None, None), (None, None, None, None, None), (9, long, "de", "s4", 1),
        (10, prose(4, 50) + "\n" + " ".join(words[10:60]) + "\n" + prose(5, 40), "en", "s1", 1), (11, "one", "en", "s1", 3),
        (12, "123 ... !!! ---", "en", "s1", 1), (13, "x y   été \U0001F600", "fr", "", 1), (14, long[:100_000] + " end", "de", "s4", 1),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(tricky(), DOCS)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"own {c.split()[0]}").alias(c.split()[0]) for c in CLASHES.split(", ")])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
