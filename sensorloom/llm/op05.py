"""Query of the toxicity operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import documents, durable, fold, labels
from sensorloom.llm.toxicity import described, fit_weights, learn_lexicon, sample, scored

FOLDS, HELD_OUT, LEAST = 5, 0, 0.5


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    given = labels(spark, folder).where(F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    known = sample(given.select("doc_id", F.col("toxic").alias("y")).distinct())
    # the ids of the sample, two rows each at most, go to the texts, not the texts to them
    train = durable(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    lexicon = learn_lexicon(train)
    seen = described(train, lexicon, keep=["y"]).select("features", "y").collect()  # the sample's rows only
    weights = fit_weights([(list(r.features), r.y) for r in seen])
    rows = described(docs, lexicon, keep=["doc_id"])
    return scored(rows.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT), weights, least=LEAST)


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
