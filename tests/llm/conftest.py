from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SF0001 = "/root/testdata/sf0.001"
#: Names that the operators use inside.
NAMES = "n size key prefix row spans cls label g block train positive x m at group v base score rank places found taken".split()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF0001}/labels.parquet")


@pytest.fixture(scope="session")
def frame(spark):
    """rows of (doc_id, text) -> documents with clashing extra columns."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit("clash") for c in NAMES})

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls in every column, empty and odd texts, one very long text, ties and repeated rows."""
    rng = random.Random(7)
    some = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(60))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, some), (6, some), (6, some), (7, some + " tail"), (None, some), (None, None),
        (8, "token = 'abcdef123' and é日本 <|endoftext|>"), (9, some.upper()), (10, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))),
    ]


@pytest.fixture(scope="session")
def empty(frame):
    return frame([]).where("false")
