import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_row", "_id", "_key", "_gone", "_c", "_f", "_s", "p", "key", "found", "size", "shard", "rank", "sig", "node", "length", "score"]


def prose(rng: random.Random, n: int, letters: str = "abcdefghij") -> str:
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


def edited(rng: random.Random, text: str, share: float) -> str:
    words = text.split(" ")
    for i in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = "changed" + str(rng.randint(0, 10**6))
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, repeated rows, and copies."""
    rng = random.Random(7)
    base = prose(rng, 120)
    out = [
        (None, prose(rng, 40), "en", "a", 1), (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "Word.", "en", None, 5),
        (5, base, "en", "a", len(base)), (6, base, "en", "a", len(base)), (6, base, "en", "a", len(base)), (7, base.upper(), "en", "a", 9), (8, prose(rng, 20000), "en", "a", 9),
    ]
    out += [(100 + i, edited(rng, base, 0.02), "en", "b", 9) for i in range(20)]
    out += [(200 + i, edited(rng, base, 0.3), "en", "b", 9) for i in range(10)]
    out += [(300 + i, prose(rng, rng.randint(1, 80)), "fr", "c", 9) for i in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(spark, rows):
    """The same rows with further columns under names that the operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"extra {c}") for c in CLASHING})
