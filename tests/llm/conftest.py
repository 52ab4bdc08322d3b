"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, Row int, low string"
random_ = random.Random(5)
VOCABULARY = ["the", "And", "of", "erly", "thion", "ndre", "über", "écha", "ñez", "wh,", "st.", "onre", "ing", "ha", "ed"]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(VOCABULARY) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = prose(120, 1)
    words = base.split(" ")
    texts = {
        1: base, 2: base, 3: " ".join(words[:-3] + ["other", "words", "here"]), 4: prose(120, 2), 5: None, 6: "", 7: " \t\n ", 8: "one", 9: "ONE",
        10: "one two", 11: prose(9_000, 3), 12: prose(9_000, 3) + "tail", 13: base.upper(), 14: None, 15: "ßéñ\U0001f600 x", 16: prose(40, 4),
    }
    rows = [(i, t, "en", "s", None, 0.5, "x", 1, "low") for i, t in texts.items()]
    return rows + [(4, texts[4], "en", "s", None, 0.5, "x", 1, "low"), (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 3 and 1, int(i % 4 == 0)) for i in range(1, 17)] + [(3, None, None), (None, 1, 1), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
