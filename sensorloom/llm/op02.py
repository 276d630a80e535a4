"""Query of the mixing operator."""

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.common import documents
from sensorloom.llm.mixing import Mix, taken_words

MIX = Mix(weights=(3, 1, 2), share=1.5, repeat=2)


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return taken_words(documents(spark, folder), MIX)


QUERIES = {"op2_source_mix": op2_source_mix}
SQL: dict[str, str] = {}
