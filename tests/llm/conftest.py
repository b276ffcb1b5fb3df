import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, cut string, key string, size int"


def words(rng, n, seed="abcdefgh"):
    return " ".join("".join(rng.choices(seed, k=rng.randint(2, 6))) for _ in range(n))


def sentences(rng, n, least=6, most=14):
    return " ".join(words(rng, rng.randint(least, most)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rng = random.Random(7)
    base = sentences(rng, 30)
    rows = [
        (0, base, "en", "a"),
        (0, base, "en", "a"),
        (1, base, "en", None),
        (2, base.replace("a", "b", 1), "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \n\t ", "de", "c"),
        (6, "one two", "de", "c"),
        (7, "one two", None, "c"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (8, sentences(rng, 9000), "en", "a"),
        (9, "x" * 200_000, "en", "a"),
        (10, "é ü 漢字 🙂 <|endoftext|> ### </turn>", "fr", "d"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, 1, "c", "k", 3) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
