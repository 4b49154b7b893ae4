import random

import pytest

from llm_tables import make
from lodegraph.llm import common


@pytest.fixture(autouse=True)
def several_buckets(monkeypatch):
    """Small tables, too, are dealt out to several buckets."""
    monkeypatch.setattr(common, "BUCKET_LEAST", 1)


@pytest.fixture(scope="session")
def corner_rows():
    """Nulls, empty and very long texts, ties, repeated rows and ids."""
    rng = random.Random(1)
    vocabulary = "the of and to house river stone light over under green small walks sings from".split()
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(120)
    words = base.split()
    near = " ".join([*words[:60], "CHANGED", *words[61:]])
    return [
        (1, base, "en"), (2, base, "en"), (3, near, "en"), (4, None, None), (5, "", "en"), (6, " \t\n", None), (7, "one two", "en"), (8, "One  two", "en"),
        (9, prose(30_000), "en"), (10, prose(200), "en"), (10, prose(200), "en"), (1, base, "en"), (None, base, "en"), (None, None, None), (11, "é ß 你好 ñ Σς", None),
        (12, "12 34 %% !!", None), (13, "\x1c\x85 x", None), (14, "a" * 5000, "en"),
    ]


@pytest.fixture(scope="session")
def corner(spark, corner_rows):
    return make(spark, corner_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
