"""Query of the token count operator."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.common import documents
from sensorloom.llm.prefixes import token_counts

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), public_tokenizers.path(TOKENIZER), limit=LIMIT, keep=["doc_id"])


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
