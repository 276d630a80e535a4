"""A small table with everything that operators must bear."""

import pytest
from pyspark.sql import types as T

from sensorloom.llm.common import importable

CLASHING = ["score", "size", "fp", "kind", "row", "bucket", "features", "lang_pred", "root", "start", "h", "n", "y", "cell"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)
EN = "the quick brown fox jumps over the lazy dog while many people watch it from the garden wall "
DE = "der schnelle braune fuchs springt ueber den faulen hund und viele leute sehen von der mauer zu "
LONG = " ".join(f"word{i % 977} and {EN.split()[i % 18]}" for i in range(30_000))


def rows():
    base = [
        (1, EN * 3, "en", "a"),
        (2, EN * 3 + "today", "en", "a"),
        (3, DE * 4, "de", "b"),
        (4, DE * 2 + "heute schon wieder nicht", "de", None),
        (5, None, "en", "a"),
        (6, "", None, "b"),
        (7, " \n\t ", "en", None),
        (8, LONG, "en", "a"),
        (9, EN * 3, "en", "b"),
        (9, EN * 3, "en", "b"),
        (None, "mail ann.b@example.com or call +1 (212) 555-0142 now", "en", "c"),
        (11, "ip 10.0.0.1 card 4111 1111 1111 1111 version 2.0. and 300.1.1.1", None, "c"),
        (12, "12345 67 8", "en", "c"),
        (13, "naïve café \U0001f600 ünïcode", "fr", "d"),
    ]
    return [(i, t, lang, s, len(t or ""), *(["x"] * len(CLASHING))) for i, t, lang, s in base]


@pytest.fixture(scope="session")
def odd(spark):
    importable(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def plain(spark):
    importable(spark)

    def make(pairs, columns="doc_id long, text string"):
        return spark.createDataFrame(pairs, columns)

    return make


@pytest.fixture(scope="session")
def given(plain):
    return plain
