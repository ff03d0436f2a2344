import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, length int, piece string, `key` int, terms string, h double, score string"


def sentence(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(n))


def make(spark, rows):
    """Documents with further columns whose names the operators also use."""
    full = [(i, t, "en", "s", len(t) if t else None, "own", 7, "p", None, "t", 0.5, "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids."""
    draw = random.Random(5)
    long = "\n".join(sentence(draw, 30) for _ in range(3000))
    base = sentence(draw, 60)
    rows = [
        (1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, "  \n\t "), (7, "!!! ..."),
        (None, base), (None, None), (None, "one two"), (8, long), (9, long), (10, "a" * 200_000), (11, "é ß 日本 ١٢ \U0001f600"),
        (12, "short text"), (12, "other text for the same id"), (13, base.upper() + "\r\nAll rights reserved.\r\n"),
    ]
    return make(spark, rows).persist()


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
