"""Query of the quality classifier."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import documents, durable, fold, labels
from sensorloom.llm.quality_model import described, fit, scored

FOLDS, HELD_OUT, LEAST = 4, 2, 0.7


def op10_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    rows = durable(described(docs, keep=["doc_id"])).withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT)
    known = labels(spark, folder).select("doc_id", "quality").where("quality is not null")
    model = fit(rows.where(~F.col("held_out")).join(known, "doc_id"), "quality")
    return scored(rows, model, least=LEAST)


QUERIES = {"op10_quality_model": op10_quality_model}
SQL: dict[str, str] = {}
