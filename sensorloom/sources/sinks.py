"""Sinks, and cutting a long plan at a durable copy."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.names import col


def _checkpoint_ready(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="sensorloom-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors reach."""
    _checkpoint_ready(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Write the rows once to the checkpoint folder and go on from there."""
    _checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def write_minutes(df: DataFrame, path: str, ts: str, *, keys: Sequence[str] = (), only: tuple | None = None) -> None:
    """Minute data by date, clustered so that a date is a few large files, sorted for row-group skipping."""
    write_dates(df.withColumn("date", F.to_date(col(ts))), path, [*keys, ts], only=only)


def write_dates(df: DataFrame, path: str, order: Sequence[str], *, only: tuple | None = None) -> None:
    """A table with a ``date``, a folder for each. With ``only`` (first, last) just those dates are replaced; one of them
    that no longer has a row goes."""
    if only is not None:
        df = df.where(F.col("date").between(*[F.lit(d).cast("date") for d in only]))
    (
        df.repartition("date", *[col(k) for k in order[:-1]])
        .sortWithinPartitions("date", *[col(k) for k in order])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if only is None else "dynamic")
        .partitionBy("date")
        .parquet(path)
    )
    if only is not None:
        _drop_dates(df, path, only)


def _drop_dates(df: DataFrame, path: str, only: tuple) -> None:
    spark = df.sparkSession
    written = {r[0] for r in df.select("date").distinct().collect()}  # as many as replaced dates
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    day = only[0]
    while day <= only[1]:
        if day not in written:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/date={day}"), True)
        day += timedelta(days=1)


def write_small(df: DataFrame, path: str) -> None:
    """Hour, day and period tables, predictions: plain Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str, order: Sequence[str], *, file: str = "file", line: str = "line") -> None:
    """Text files, a folder for each value of ``file``, whose lines follow ``order``. A file is written by one task."""
    (
        lines.repartition(col(file))
        .sortWithinPartitions(col(file), *[col(c) for c in order])
        .select(col(file), col(line))
        .write.partitionBy(file)
        .text(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One-row or long metadata tables, nested columns included."""
    df.write.mode("overwrite").json(path)
