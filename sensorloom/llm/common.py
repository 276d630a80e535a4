"""Helpers of this subpackage: safe names, bounded slices of Arrow batches, durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into objects at a time.
SLICE_BYTES = 2 << 20
#: Bytes of one batch sent to a Python worker.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package from a source checkout, whatever folder the driver was started in.

    Where the session has the default limit for the batches that they get, it becomes ``BATCH_BYTES``: documents are long.
    """
    if spark.conf.get(_LIMIT) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(_LIMIT, BATCH_BYTES)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't use in any spelling."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names, in any spelling: a result column takes the place of an equally named one."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone])


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % parts


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, set up for checkpoints; a local session without one gets its own folder."""
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of rows with about ``SLICE_BYTES`` of text each; a longer text is a run of its own.

    After the last one, memory that Arrow holds in reserve is given back: the worker stays and serves other stages.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
        del batch
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a slice; a null text is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts of a slice; a null text is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, drop: set[str], **more: pa.Array) -> pa.RecordBatch:
    """The batch without ``drop`` and with further columns at its end."""
    keep = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *more.values()], names=[*keep, *more])


def simple(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, the text as a string."""
    return docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in columns])
