"""Query of the language identification operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import documents, fold
from sensorloom.llm.langid import Samples, identify, learn

FOLDS, HELD_OUT = 4, 2


def train(docs: DataFrame) -> Samples:
    return learn(docs, fold("doc_id", FOLDS) != HELD_OUT)


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held = docs.select("doc_id", "text", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    return identify(held, train(docs), keep=["doc_id", "held_out"])


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
