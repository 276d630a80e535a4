"""Query of the SimHash near-duplicate operator."""

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.common import documents
from sensorloom.llm.simhash import near_duplicates


def op8_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(documents(spark, folder), shingle=3, max_bits=3)
    return found.select("doc_id", "fingerprint", "component_id")


QUERIES = {"op8_simhash_groups": op8_simhash_groups}
SQL: dict[str, str] = {}
