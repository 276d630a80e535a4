"""Minute bins, complete grids and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.names import col
from sensorloom.functions.numeric import number
from sensorloom.functions.timekit import as_time, bin_start, bucket_no, minutes_between
from sensorloom.operators.windows import DAY, carry


def minute_bins(
    df: DataFrame,
    ts: str,
    *,
    means: Sequence[str] = (),
    maxima: Sequence[str] = (),
    keys: Sequence[str] = (),
    minutes: int = 1,
) -> DataFrame:
    """Mean of continuous and maximum of binary columns per bin. Aggregated map-side first."""
    return df.groupBy(*[col(k) for k in keys], bin_start(ts, minutes).alias(ts)).agg(
        *[F.avg(number(c)).alias(c) for c in means], *[F.max(col(c)).alias(c) for c in maxima]
    )


def spine(df: DataFrame, ts: str, *, keys: Sequence[str] = (), minutes: int = 1) -> DataFrame:
    """Every bin from the first to the last of each series, made day by day on the executors."""
    t = bin_start(ts, minutes)
    ends = df.groupBy(*[col(k) for k in keys]).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    width = max(DAY, minutes)
    days = ends.where(F.col("__lo").isNotNull()).withColumn(
        "__day",
        F.explode(F.sequence(bin_start("__lo", width), bin_start("__hi", width), F.expr(f"INTERVAL {width} MINUTES"))),
    )
    # a day row grows to its minutes, so the day rows are spread first, whatever their key
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = days.repartition(n, *[col(k) for k in keys], F.col("__day"))
    first = F.greatest(F.col("__day"), F.col("__lo"))
    last = F.least(F.col("__day") + F.expr(f"INTERVAL {width - minutes} MINUTES"), F.col("__hi"))
    return days.select(
        *[col(k) for k in keys],
        F.explode(F.sequence(first, last, F.expr(f"INTERVAL {minutes} MINUTES"))).alias(ts),
    )


def on_grid(
    binned: DataFrame, ts: str, *, keys: Sequence[str] = (), minutes: int = 1, source: DataFrame | None = None
) -> DataFrame:
    """Add the missing bins of a binned table as rows of nulls.

    ``source`` is where the first and last time are read; pass the raw table so
    that only its time column is scanned again.
    """
    base = spine(source if source is not None else binned, ts, keys=keys, minutes=minutes)
    return base.join(binned, [*keys, ts], "left").select([col(n) for n in binned.columns])


def filled_minutes(
    df: DataFrame,
    ts: str,
    *,
    means: Sequence[str] = (),
    maxima: Sequence[str] = (),
    keys: Sequence[str] = (),
    minutes: int = 1,
    fill: Sequence[str] = (),
    limit: int = 0,
    hold: Sequence[str] = (),
    carried: dict[str, object] | None = None,
    flag: str | None = None,
    span: int = DAY,
) -> DataFrame:
    """Bin a raw log, complete the grid, fill gaps and carry values in one layout of the bins.

    The bins are shuffled once, to (keys, bucket of ``span`` minutes). Each bin there knows the next one of its series
    and grows into the missing bins between the two, so the grid needs no join with a table of all minutes. What lies
    beyond a bucket's edges comes from one summary row per bucket, taken from the same exchange.

    ``fill`` and ``hold`` are as in ``fill_gaps``. ``carried`` names columns to carry forward without limit, with their
    value before the first one; ``flag`` is 1 where one of ``means`` is missing before the filling. Rows without a
    time or key are left out.
    """
    df = df.withColumn(ts, as_time(ts)).where(col(ts).isNotNull())
    for k in keys:
        df = df.where(col(k).isNotNull())  # the join below asks for it on one side only, which would part the exchange
    bins = minute_bins(df, ts, means=means, maxima=maxima, keys=keys, minutes=minutes)
    carried, both = dict(carried or {}), [*fill, *[c for c in carried or {} if c not in fill]]
    # a bin may grow to a day of them, so their number of partitions is given and not merged by size
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = bins.withColumn("__b", bucket_no(ts, span)).repartition(n, *[col(k) for k in keys], F.col("__b"))
    at = col(ts)
    stamped = {i: F.when(col(c).isNotNull(), F.struct(at.alias("t"), col(c).alias("v"))) for i, c in enumerate(both)}

    # the whole first row is taken: with the same columns read, summary and rows share the exchange
    rest = [col(n) for n in bins.columns if n not in both and n not in keys and n != ts]
    summary = work.groupBy(*[col(k) for k in keys], "__b").agg(
        F.min_by(F.struct(at.alias("t"), *rest), at).alias("__first"),
        *[F.max_by(x, F.when(x.isNotNull(), at)).alias(f"__l{i}") for i, x in stamped.items()],
        *[F.min_by(x, F.when(x.isNotNull(), at)).alias(f"__e{i}") for i, x in stamped.items() if i < len(fill)],
    )
    line = Window.partitionBy(*[col(k) for k in keys])  # one row a bucket
    up = line.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    down = line.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    far = summary.select(
        *[col(k) for k in keys],
        "__b",
        F.lead("__first").over(line.orderBy("__b"))["t"].alias("__next"),
        *[F.last(f"__l{i}", ignorenulls=True).over(up).alias(f"__l{i}") for i in stamped],
        *[F.last(f"__e{i}", ignorenulls=True).over(down).alias(f"__e{i}") for i in stamped if i < len(fill)],
    )

    here = Window.partitionBy(*[col(k) for k in keys], F.col("__b"))
    so_far = here.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    later = here.orderBy(at.desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = work.withColumns(
        {
            "__to": F.lead(at).over(here.orderBy(at)),
            **{f"__p{i}": F.last(x, ignorenulls=True).over(so_far) for i, x in stamped.items()},
            **{f"__f{i}": F.last(x, ignorenulls=True).over(later) for i, x in stamped.items() if i < len(fill)},
        }
    )
    step, width = F.expr(f"INTERVAL {minutes} MINUTES"), max(DAY, minutes) // minutes * minutes
    last = F.coalesce(F.col("__to"), F.col("__next"), at + step) - step
    rows = near.join(far, [*keys, "__b"], "left")
    # by days first: no array is longer than the bins of a day or the days of a gap
    rows = rows.withColumn("__last", last).withColumn(
        "__day", F.explode(F.sequence(at, F.col("__last"), F.expr(f"INTERVAL {width} MINUTES")))
    )
    until = F.least(F.col("__day") + F.expr(f"INTERVAL {width - minutes} MINUTES"), F.col("__last"))
    rows = rows.withColumn("__at", F.explode(F.sequence(F.col("__day"), until, step)))

    own = F.col("__at") == at
    value = {n: F.when(own, col(n)) for n in (*means, *maxima)}
    out = dict(value)
    for i, c in enumerate(both):
        p = F.coalesce(F.col(f"__p{i}"), F.col(f"__l{i}"))
        if i < len(fill):
            f = F.coalesce(F.col(f"__f{i}"), F.col(f"__e{i}"))
            out[c] = _interpolated(value[c], p, f, F.col("__at"), limit, c in hold)
        if c in carried:
            out[c] = F.coalesce(out[c], p["v"], F.lit(carried[c]).cast(bins.schema[c].dataType))
    marks = [value[c].isNull().cast("int") for c in means]
    mark = F.greatest(*marks) if len(marks) > 1 else marks[0] if marks else F.lit(0)
    return rows.select(
        *[col(k) for k in keys],
        F.col("__at").alias(ts),
        *[out[n].alias(n) for n in (*means, *maxima)],
        *([mark.alias(flag)] if flag else []),
    )


def minute_grid(
    df: DataFrame,
    ts: str,
    *,
    means: Sequence[str] = (),
    maxima: Sequence[str] = (),
    keys: Sequence[str] = (),
    minutes: int = 1,
) -> DataFrame:
    """Bin a raw log and complete the grid."""
    df = df.withColumn(ts, as_time(ts)).where(col(ts).isNotNull())
    bins = minute_bins(df, ts, means=means, maxima=maxima, keys=keys, minutes=minutes)
    return on_grid(bins, ts, keys=keys, minutes=minutes, source=df)


def mark_missing(df: DataFrame, columns: Sequence[str], name: str = "interp_flag") -> DataFrame:
    """1 where any of the columns is missing."""
    marks = [col(c).isNull().cast("int") for c in columns]
    return df.withColumn(name, F.greatest(*marks) if len(marks) > 1 else marks[0] if marks else F.lit(0))


def _interpolated(value: Column, p: Column, f: Column, at: Column, limit: int, hold: bool) -> Column:
    """A missing value on the line from the stamped value before to the one after, within ``limit`` minutes."""
    age, gap = minutes_between(p["t"], at), minutes_between(p["t"], f["t"])
    slope = F.when(gap > 0, (f["v"] - p["v"]) / gap)
    reach = F.least(age, F.lit(float(limit)))
    line = F.coalesce(p["v"] + slope * reach, p["v"])
    return F.when(value.isNotNull(), value).when(F.lit(hold) | (age <= limit), line)


def fill_gaps(
    df: DataFrame,
    ts: str,
    columns: Sequence[str],
    *,
    limit: int,
    hold: Sequence[str] = (),
    keys: Sequence[str] = (),
    span: int = DAY,
) -> DataFrame:
    """Time-linear interpolation of the first ``limit`` minutes of every gap.

    A trailing gap repeats the last value under the same limit; a leading gap stays
    empty. Columns in ``hold`` keep the value reached at the limit for the rest of
    the gap, which equals a forward fill after the interpolation.
    """
    if not columns:
        return df
    stamped = {c: F.when(col(c).isNotNull(), F.struct(col(ts).alias("t"), col(c).alias("v"))) for c in columns}
    wide = carry(
        df,
        ts,
        last={f"__p{i}": stamped[c] for i, c in enumerate(columns)},
        following={f"__f{i}": stamped[c] for i, c in enumerate(columns)},
        keys=keys,
        span=span,
    )
    filled = {}
    for i, c in enumerate(columns):
        filled[c] = _interpolated(col(c), F.col(f"__p{i}"), F.col(f"__f{i}"), col(ts), limit, c in hold)
    return wide.select([filled[n].alias(n) if n in filled else col(n) for n in df.columns])
