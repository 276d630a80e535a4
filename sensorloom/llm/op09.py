"""Query of the personal-data operator."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import documents
from sensorloom.llm.pii import BASE, find_spans, spelled


def _number(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = find_spans(documents(spark, folder), keys=["doc_id"])
    base = F.filter("found", lambda s: s["base"])
    counts = [_number(k).alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("found")).alias("spans"),
    )


QUERIES = {"op9_personal_data": op9_personal_data}
SQL: dict[str, str] = {}
