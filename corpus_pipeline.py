"""From raw documents to packed training sequences.

Each stage reads the documents that the one before it kept. It takes ``(spark, docs, folder)`` and returns a DataFrame that
is written as Parquet and read again for the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.common import importable, shared_folder
from sensorloom.llm.langid import accept
from sensorloom.llm.mixing import mixed
from sensorloom.llm.op01 import TOKENIZER
from sensorloom.llm.op02 import MIX
from sensorloom.llm.op07 import train
from sensorloom.llm.packing import pack
from sensorloom.llm.pii import redact
from sensorloom.llm.simhash import keep_first

LENGTH = "n_chars"


def _length(docs: DataFrame) -> str | None:
    return LENGTH if LENGTH in docs.columns else None


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in one of the learned languages, which becomes their ``lang``; texts without a letter go."""
    importable(spark)
    return accept(docs, train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by 3 or fewer differing fingerprint bits."""
    importable(spark)
    return keep_first(docs, shingle=3, max_bits=3)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The same documents; personal data in the text gives way to its kind in brackets."""
    return redact(docs, size=_length(docs))


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """What the mix takes of each document: no row, one, or two where it is taken twice."""
    importable(spark)
    return mixed(docs, MIX, size=_length(docs))


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where each piece of each document lies in its packed sequence."""
    importable(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("sequences", sequences),
]
#: Fingerprints, suffix automata and tokenizers have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each but the last keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
