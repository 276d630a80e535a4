"""Table sources: Parquet, CSV, the analysis frame set, and optional side tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import col, present
from sensorloom.functions.timekit import parse_time


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the path's own file system, local or remote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_parquet(spark: SparkSession, path: str, ts: str | None = None) -> DataFrame | None:
    """Parquet scan, or None when the path is absent. NaN becomes NULL, a naive time a UTC instant.

    Rows stay unordered; order is made where a window or a sink needs it.
    """
    if not path_exists(spark, path):
        return None
    df = nan_to_null(spark.read.parquet(path))
    naive = ts is not None and df.schema[ts].dataType.simpleString() == "timestamp_ntz"
    return df.withColumn(ts, col(ts).cast("timestamp")) if naive else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Aggregates treat NaN as a value, so it must not enter."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.nanvl(col(n), F.lit(None)) for n in doubles}) if doubles else df


def read_csv(spark: SparkSession, path: str, times: tuple[str, ...] = ()) -> DataFrame | None:
    """CSV with header as text; named time columns are parsed, others stay as they are."""
    if not path_exists(spark, path):
        return None
    df = spark.read.csv(path, header=True)
    return df.withColumns({t: parse_time(t) for t in present(df, times)}) if times else df


def parse_optional_dates(df: DataFrame) -> DataFrame:
    """The known date columns of a side table as times; bad text is NULL."""
    return df.withColumns({c: parse_time(c) for c in present(df, plant.OPTIONAL_DATE_COLUMNS)})


def check_optional_table(df: DataFrame, title: str) -> DataFrame:
    """One row: valid flag, required groups without any column, absent recommended columns."""
    groups, recommended = plant.OPTIONAL_TABLES[title]
    have = set(df.columns)
    missing = [sorted(g) for g in groups if have.isdisjoint(g)]
    lacking = [c for c in recommended if c not in have]
    rows = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("n") > 0
    all_groups = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    gaps = F.array(*[F.array(*[F.lit(c) for c in g]) for g in missing]).cast("array<array<string>>")
    return rows.select(
        F.lit(title).alias("title"),
        (filled & F.lit(not missing)).alias("is_valid"),
        F.when(filled, gaps).otherwise(all_groups).alias("missing_required_groups"),
        F.when(filled, F.array(*[F.lit(c) for c in lacking]).cast("array<string>"))
        .otherwise(F.array(*[F.lit(c) for c in recommended]))
        .alias("missing_recommended"),
    )


def _typed_metrics(df: DataFrame | None) -> DataFrame | None:
    """Event metrics with numbers, as they are when computed."""
    if df is None:
        return None
    kinds = {**dict.fromkeys(plant.EVENT_METRICS, "double"), "n_events": "bigint"}
    return df.withColumns({c: col(c).try_cast(kinds[c]) for c in present(df, list(kinds))})


@dataclass
class FrameSet:
    """The tables an analysis works on; absent ones are None."""

    minute: DataFrame | None = None
    hourly: DataFrame | None = None
    daily: DataFrame | None = None
    monthly: DataFrame | None = None
    weekday: DataFrame | None = None
    event_metrics: DataFrame | None = None
    events: DataFrame | None = None
    side_tables: dict[str, DataFrame | None] = field(default_factory=dict)


def load_frames(
    spark: SparkSession,
    folder: str,
    *,
    enrich: Callable[[DataFrame], DataFrame],
    hourly_from_minute: Callable[[DataFrame], DataFrame],
    ts: str = "ts",
    side_tables: dict[str, str] | None = None,
) -> FrameSet:
    """Lazily read the frame set of a folder; hourly data is rebuilt from minutes when absent.

    Minutes that the build job has enriched already are taken as they are, so that a clip reaches their scan.
    """
    minute = read_parquet(spark, f"{folder}/minute", ts)
    if minute is not None and not set(plant.ENRICHED) <= set(minute.columns):
        minute = enrich(minute)
    hourly = read_parquet(spark, f"{folder}/hourly", ts)
    if hourly is None and minute is not None:
        hourly = hourly_from_minute(minute)
    side = {
        title: (parse_optional_dates(t) if (t := read_csv(spark, f"{folder}/{name}")) is not None else None)
        for title, name in (side_tables or {}).items()
    }
    return FrameSet(
        minute=minute,
        hourly=hourly,
        daily=read_parquet(spark, f"{folder}/daily"),
        monthly=read_parquet(spark, f"{folder}/monthly"),
        weekday=read_parquet(spark, f"{folder}/weekday"),
        event_metrics=_typed_metrics(read_csv(spark, f"{folder}/event_metrics")),
        events=read_parquet(spark, f"{folder}/events", ts),
        side_tables=side,
    )
