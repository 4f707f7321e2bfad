import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id bigint, size int, digest string"


def awkward_rows(seed=3, n=60):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "und", "der", "the", "of", "été", "naïve", "Zürich.", "end!\n"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(1, 60)))
        rows.append((i, text, rng.choice(["en", "de", None]), "s", len(text), 1.0, 7, 1, "x"))
    rows += [(100, None, "en", None, None, None, None, None, None), (101, "", "en", "s", 0, 0.0, 1, 1, ""), (102, " \t\n ", None, "s", 3, 0.0, 1, 1, "")]
    rows += [(103, "word " * 40_000, "en", "s", 1, 0.0, 1, 1, ""), (104, "x" * 150_000, "de", "s", 1, 0.0, 1, 1, "")]
    rows += [(105, rows[0][1], "en", "s", 1, 0.0, 1, 1, ""), rows[1], rows[1], (None, "no id at all here", "en", "s", 1, 0.0, 1, 1, "")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
