import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _k string, node string, anchor string, score string, _row string, words string"


def prose(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def messy_rows():
    """Nulls in every column, empty and long texts, copies, ties, rows that share an id."""
    rng = random.Random(5)
    base = prose(rng, 150)
    near = base.split()
    near[70] = "other"
    long = prose(rng, 30_000)
    passage = prose(rng, 40)
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, ""), (5, None), (6, "   \n\t "), (7, long), (8, long + " end"), (None, base), (None, prose(rng, 90)),
        (9, f"{prose(rng, 60)} {passage} {prose(rng, 60)}"), (10, f"{prose(rng, 50)} {passage}\n{prose(rng, 70)}"), (10, f"{prose(rng, 50)} {passage}\n{prose(rng, 70)}"),
        (11, "ab " * 300), (12, "x"), (13, "é ß ñ " * 60), (14, prose(rng, 120) + " \x00 end"), (1, base), (15, "zz" * 40_000),
    ]


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "k", "n", "a", "s", "r", None) for i, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
