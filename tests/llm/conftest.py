import random

import pytest

SF = "/root/testdata/sf0.001"

#: Extra columns whose names the operators use inside.
EXTRA = "id long, key long, n long, word string, part long, label string, c long, token long, name long, _id long, _text string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def frame(spark, rows):
    """Documents of (doc_id, text, lang), with clashing columns that hold something else."""
    full = [(i, t, lang, None, None, 1, 2, 3, "w", 4, "l", 5, 6, 7, 8, "t") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(4000)]
    long = " ".join(words) + " é" * 500
    return [
        (1, "The quick brown fox jumps over the lazy dog again", "en"),
        (2, "the QUICK brown fox jumps over the lazy dog again", "en"),
        (2, "the QUICK brown fox jumps over the lazy dog again", "en"),
        (3, None, None),
        (4, "", "en"),
        (5, "  \n\t ", "de"),
        (6, "...!!! 123", None),
        (7, long, "fr"),
        (8, long, "fr"),
        (9, "x", "en"),
        (None, "der die das und nicht mit ein eine", "de"),
        (10, "der die das und nicht mit ein eine", "de"),
        (2, "another text that shares an id", "en"),
        (11, "ab" * 30_000, None),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
