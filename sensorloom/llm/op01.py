"""Query of the packing operator."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.common import documents
from sensorloom.llm.packing import pack

TOKENIZER = "byte_bpe_50k.json"


def op1_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), public_tokenizers.path(TOKENIZER))


QUERIES = {"op1_pack_sequences": op1_pack_sequences}
SQL: dict[str, str] = {}
