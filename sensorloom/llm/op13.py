"""Query of the I-Match fingerprints."""

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.common import documents, simple
from sensorloom.llm.imatch import beside_next, lexicon


def op13_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = simple(documents(spark, folder), "doc_id", "text")
    return beside_next(docs, lexicon(docs))


QUERIES = {"op13_document_fingerprints": op13_document_fingerprints}
SQL: dict[str, str] = {}
