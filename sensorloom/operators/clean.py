"""Row cleaning, deduplication, time selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.names import col, present
from sensorloom.functions.numeric import flag, number
from sensorloom.functions.timekit import as_time, parse_time, shift_minutes


def first_per_time(
    df: DataFrame, ts: str, order: Sequence[str | Column], *, keys: Sequence[str] = ()
) -> DataFrame:
    """Keep the first row of every time stamp. Combines map-side, so a crowded stamp is no hot task."""
    ident = [*keys, ts]
    rest = [n for n in df.columns if n not in ident]
    rank = F.struct(*[(col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    kept = df.groupBy(*[col(n) for n in ident]).agg(
        F.min_by(F.struct(*[col(n).alias(f"c{i}") for i, n in enumerate(rest)]), rank).alias("__row")
    )
    places = {n: f"__row.c{i}" for i, n in enumerate(rest)}
    return kept.select([F.col(places[n]).alias(n) if n in places else col(n) for n in df.columns])


def drop_unusable(df: DataFrame, required: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """Drop rows that are empty, lack a required value, or repeat the header (``label`` in its own column)."""
    out = df.dropna(how="all")
    if required:
        out = out.dropna(subset=[f"`{r}`" for r in required])
    if label is not None:
        out = out.where(col(label).isNull() | (col(label).cast("string") != label))
    return out


def coerce(df: DataFrame, continuous: Sequence[str], binary: Sequence[str]) -> DataFrame:
    """Continuous columns to double (bad text is NULL), binary columns to 0/1 integers."""
    return df.withColumns({**{c: number(c) for c in continuous}, **{b: flag(b) for b in binary}})


def first_filled(df: DataFrame, target: str, sources: Sequence[str]) -> DataFrame:
    """First non-null value across alternate columns."""
    have = present(df, sources)
    return df.withColumn(target, F.coalesce(*[col(c) for c in have])) if have else df


def pick_time_column(df: DataFrame, candidates: Sequence[str], ts: str) -> DataFrame:
    """Use the first candidate that holds any valid time. One small aggregate decides."""
    have = present(df, candidates)
    if not have:
        raise ValueError(f"none of {list(candidates)} is a column")
    seen = df.agg(*[F.count(parse_time(c)).alias(f"n{i}") for i, c in enumerate(have)]).first()
    chosen = next((c for i, c in enumerate(have) if seen[i] > 0), None)
    if chosen is None:
        raise ValueError(f"no valid time in {have}")
    return df.withColumn(ts, parse_time(chosen))


def columns_with_data(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value; one aggregate for all of them."""
    have = present(df, columns)
    if not have:
        return []
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(have)]).first()
    return [c for i, c in enumerate(have) if row[i] > 0]


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def availability(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: how many of all rows hold a value."""
    names = list(columns or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(names)])
    return wide.select(F.explode(pairs).alias("p"), "__rows").select(
        F.col("p.column").alias("column"),
        F.col("p.n").alias("n_values"),
        F.col("__rows").alias("n_rows"),
        (F.col("p.n") > 0).alias("has_data"),
    )


def clip_time(df: DataFrame, ts: str, start, end, *, date_column: str | None = None) -> DataFrame:
    """Rows with ``start <= ts <= end``.

    The bounds take the type of the column, so the filter reaches the Parquet scan;
    clip a naive time column before it is cast. ``date_column`` prunes date partitions too.
    """
    kind = df.schema[ts].dataType.simpleString()
    kind = kind if kind in ("timestamp", "timestamp_ntz", "date") else "timestamp"
    lo, hi = (F.lit(x).cast("timestamp").cast(kind) for x in (start, end))
    inside = col(ts).cast(kind).between(lo, hi)
    if date_column is not None:
        inside = inside & col(date_column).between(lo.cast("date"), hi.cast("date"))
    return df.where(inside)


def window_bounds(df: DataFrame, ts: str, mode: str = "full", start=None, end=None) -> DataFrame:
    """One row ``(start_ts, end_ts)``: full record, ``last30``, ``last60`` or ``custom`` dates.

    The end is the last minute of its day; reversed custom dates are swapped.
    """
    ends = df.agg(F.to_date(F.min(as_time(ts))).alias("lo"), F.to_date(F.max(as_time(ts))).alias("hi"))
    if mode in ("last30", "last60"):
        back = 29 if mode == "last30" else 59
        first, final = F.greatest(F.col("lo"), F.date_sub("hi", back)), F.col("hi")
    elif mode == "custom":
        a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
        first, final = F.least(a, b), F.greatest(a, b)
    elif mode == "full":
        first, final = F.col("lo"), F.col("hi")
    else:
        raise ValueError(f"unknown window mode {mode!r}")
    return ends.select(
        first.cast("timestamp").alias("start_ts"),
        shift_minutes(final.cast("timestamp"), 1439).alias("end_ts"),
    )


def clip_to_window(df: DataFrame, ts: str, bounds: DataFrame) -> DataFrame:
    """Rows inside a one-row ``window_bounds`` table.

    The two bounds are read first so that the filter reaches the Parquet scan as literals.
    """
    lo, hi = bounds.select("start_ts", "end_ts").first()
    return clip_time(df, ts, lo, hi)


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others (also where it is unknown)."""
    met = F.coalesce(condition, F.lit(False))
    return df.where(met), df.where(~met)
