"""Small document tables with every odd case, and plain-Python results to hold operators against."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
#: columns named like results and like working columns
CLASHES = {"kept": "'x'", "SCORE": "1", "size": "'s'", "sha": "2", "c0": "3", "_id": "4", "id": "5", "row_id": "6", "_key": "7"}


def prose(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "Other"
    long = prose(rng, 30_000, 5_000)
    return [
        (1, base, "en", "a", 1), (2, base.upper(), "en", "a", 1), (3, " ".join(near), None, None, None), (4, None, "en", "a", 0),
        (5, "", None, "b", 0), (6, " \n\t", "de", "b", 3), (7, "one two", "de", "b", 7), (8, "ONE two", "de", "c", 7),
        (9, "one  two", "fr", "c", 8), (10, long, "fr", "a", 1), (11, long + " end", "fr", "a", 1), (12, "12 34 !!", None, "d", 8),
        (13, "é ü ñ 日本 ß", "de", "d", 1), (14, prose(rng, 4), "en", "a", 1), (14, prose(rng, 40), "en", "a", 1),
        (15, "same row again", "en", "a", 1), (15, "same row again", "en", "a", 1), (None, "no id at all", "en", None, 1),
    ]


def many_rows(n: int = 250, seed: int = 1) -> list[tuple]:
    """A source and a group of copies with a third of all rows, a family of near copies, shared passages."""
    rng = random.Random(seed)
    passage, family, rows = prose(rng, 60), prose(rng, 80).split(), []
    for i in range(n):
        kind = rng.random()
        if kind < 0.33:
            text = " ".join(family[:70])
        elif kind < 0.55:
            words = [w if rng.random() > 0.02 else f"x{rng.randint(0, 9)}" for w in family]
            text = " ".join(words)
        elif kind < 0.75:
            text = prose(rng, rng.randint(1, 200)) + " " + passage
        else:
            text = prose(rng, rng.randint(1, 300))
        rows.append((i, text, rng.choice(["en", "de"]), "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 6)}", len(text)))
    return rows


def shingle_set(text) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", *[f"{v} AS `{k}`" for k, v in CLASHES.items()])


@pytest.fixture(scope="session")
def many(spark):
    return spark.createDataFrame(many_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
