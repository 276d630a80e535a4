"""Correlation, trend, phase comparison, distribution."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.names import col
from sensorloom.functions.numeric import pearson, ratio
from sensorloom.operators.joins import to_long
from sensorloom.operators.quantiles import exact_quantiles


def _rows(cells: Sequence[dict[str, Column]]) -> Column:
    return F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in cell.items()]) for cell in cells]))


#: Of a pair's rows: number, sums and squares of either side, products.
_SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def _pair_sums(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """``(a, b)`` numbers of a left and a right column, and ``_SUMS`` over the rows that have both.

    Values and the marks of where they are make one matrix a batch; products of such matrices are all sums at once. A task
    keeps one small matrix, whatever its rows, and only that leaves it. Values are taken from their column's mean.
    """
    names = list(dict.fromkeys([*left, *right]))
    value = {n: F.nanvl(col(n).cast("double"), F.lit(None).cast("double")) for n in names}
    row = df.agg(*[F.avg(value[n]).alias(f"m{i}") for i, n in enumerate(names)]).first()
    shift = np.array([row[f"m{i}"] or 0.0 for i in range(len(names))])
    at_left, at_right = [names.index(n) for n in left], [names.index(n) for n in right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(_SUMS), len(left), len(right)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            mark = ~np.isnan(x)
            x, mark = np.where(mark, x, 0.0), mark.astype(np.float64)
            a, b, ma, mb = x[:, at_left].T, x[:, at_right], mark[:, at_left].T, mark[:, at_right]
            for k, part in enumerate((ma @ mb, a @ mb, ma @ b, (a * a) @ mb, ma @ (b * b), a @ b)):
                out[k] += part
        if out[0].any():
            i, j = np.indices(out[0].shape)
            cols = [pa.array(i.ravel(), type=pa.int32()), pa.array(j.ravel(), type=pa.int32()), *[pa.array(s.ravel()) for s in out]]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", *_SUMS])

    slim = df.select(*[value[n].alias(f"v{i}") for i, n in enumerate(names)])
    sums = slim.mapInArrow(run, "a int, b int, " + ", ".join(f"{s} double" for s in _SUMS))
    noise = F.array(*[F.lit(float(max(abs(v), 1e-150)) * 1e-14) for v in shift])
    return sums.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS]).select(
        "*",
        F.element_at(noise, F.element_at(F.array(*map(F.lit, at_left)), F.col("a") + 1) + 1).alias("ea"),
        F.element_at(noise, F.element_at(F.array(*map(F.lit, at_right)), F.col("b") + 1) + 1).alias("eb"),
    )


def _pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(i, r)`` for every pair; NULL where a side is constant over the pair's rows, up to rounding."""
    left, right = list(dict.fromkeys(a for a, _ in pairs)), list(dict.fromkeys(b for _, b in pairs))
    found = _pair_sums(df, left, right)
    n = F.col("n")
    va, vb = (F.col(s * 2) - F.col(s) * F.col(s) / n for s in "xy")
    spread = (va > n * F.col("ea") * F.col("ea")) & (vb > n * F.col("eb") * F.col("eb"))
    r = (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(va * vb)
    r = F.when(spread, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))  # NULL stays out of the two
    found = found.where(n > 0).select("a", "b", r.alias("r"))
    place = [(left.index(a), right.index(b)) for a, b in pairs]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(place)])
    frame = df.sparkSession.range(1).select(F.explode(cells).alias("c")).select("c.*")
    return frame.join(F.broadcast(found), ["a", "b"], "left").select("i", "r")  # a row a pair


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long ``(a, b, r)`` matrix. All pairs come from the same small sums; their number does not multiply rows."""
    pairs = list(combinations_with_replacement(columns, 2))
    sides = F.array(
        *[
            F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in sorted({(a, b), (b, a)})])
            for a, b in pairs
        ]
    )
    out = _pair_correlations(df, pairs).select(F.explode(F.element_at(sides, F.col("i") + 1)).alias("c"), "r")
    return out.select("c.a", "c.b", "r")


def matrix_to_wide(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    return matrix.groupBy("a").agg(*[F.max(F.when(F.col("b") == c, F.col("r"))).alias(c) for c in columns])


def matrix_to_long(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide correlation matrix back to ``(a, b, r)``."""
    return to_long(wide, ["a"], {c: c for c in columns}, "b", "r")


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of each feature with the target; order by ``abs_r`` at the sink."""
    names = F.array(*[F.lit(f) for f in features])
    out = _pair_correlations(df, [(f, target) for f in features])
    return out.select(F.element_at(names, F.col("i") + 1).alias("feature"), "r", F.abs(F.col("r")).alias("abs_r"))


def lagged_correlation(
    daily: DataFrame,
    day: str,
    signal: str,
    dose: str,
    *,
    start: str | None = None,
    max_lag: int = 14,
    smooth: int = 3,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Correlation of the smoothed signal with the dose ``lag`` rows earlier, for every lag.

    Works on a daily table (one row per key and day): every lag is a column of one
    window, every correlation part of one aggregate. ``best`` marks the largest absolute value.
    """
    rows = daily if start is None else daily.where(col(day).cast("date") >= F.lit(start).cast("date"))
    line = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(day))
    lags = range(max_lag + 1)
    lagged = rows.select(
        *[col(k) for k in keys],
        F.avg(col(signal)).over(line.rowsBetween(-(smooth - 1), 0)).alias("__s"),
        *[F.lag(col(dose), n).over(line).alias(f"__d{n}") for n in lags],
    )
    wide = lagged.groupBy(*[col(k) for k in keys]).agg(*[pearson("__s", f"__d{n}").alias(f"r{n}") for n in lags])
    cells = [{"lag": F.lit(n), "r": F.col(f"r{n}")} for n in lags]
    out = wide.select(*[col(k) for k in keys], _rows(cells).alias("c")).select(
        *[col(k) for k in keys], "c.lag", "c.r"
    )
    known = F.when(F.col("r").isNotNull(), F.struct(F.abs(F.col("r")).alias("s"), (-F.col("lag")).alias("t")))
    peak = F.max_by("lag", known).over(Window.partitionBy(*[col(k) for k in keys]))
    return out.withColumn("best", F.coalesce(F.col("lag") == peak, F.lit(False)))


def linear_trend(df: DataFrame, x: str, y: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line over rows with both values; NULL with fewer than two rows or constant x."""
    both = col(x).isNotNull() & col(y).isNotNull()
    xs, ys = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    n, varied = F.count(xs), F.min(xs) != F.max(xs)
    fit = (n >= 2) & varied
    return df.groupBy(*[col(b) for b in by]).agg(
        F.when(fit, F.regr_slope(ys, xs)).alias("slope"),
        F.when(fit, F.regr_intercept(ys, xs)).alias("intercept"),
        F.when(fit, F.regr_r2(ys, xs)).alias("r2"),
        n.alias("n"),
    )


#: Terms of the continued fraction; enough for full precision on the side of the mean where it is used.
_BETA_TERMS = 200


def _beta_fraction(x: Column, rest: Column, a: Column, b: Column) -> Column:
    """Even part of the continued fraction of the incomplete beta function at ``x = 1 - rest``, from its last term to its first.

    ``x`` near 1 loses no digits: what would cancel is taken from ``rest``.
    """
    least = a * rest - b * x + 1

    def step(f: Column, n: Column) -> Column:
        e = a + 2 * n - 1
        up = (a + n - 1) * (a + b + n - 1) / (e * e) * n * (b - n) * x * x
        below = n + n * (b - n) * x / e + (a + n) / (e + 2) * (least + n * (1 + rest))
        return F.struct((below + f["up"] / f["low"]).alias("low"), up.alias("up"))

    places = F.sequence(F.lit(_BETA_TERMS), F.lit(1), F.lit(-1))
    start = F.struct(F.lit(1.0).alias("low"), F.lit(0.0).alias("up"))
    f = F.aggregate(places, start, lambda f, n: step(f, n.cast("double")), lambda f: f["up"] / f["low"])
    return 1 / (a / (a + 1) * least + f)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t: the incomplete beta function at ``df / 2`` and one half, as one expression.

    The quotient of the gamma functions at ``a + 1/2`` and ``a`` comes from its own series, twenty steps up, so no digits
    are lost to the difference of two large logarithms: it holds at any number of degrees of freedom. NULL for a NULL
    argument; an infinite t gives 0.
    """
    a, half = df.cast("double") / 2, F.lit(0.5)
    y = t.cast("double") * t / df
    x, rest = 1 / (1 + y), y / (1 + y)
    far = a + 20
    series = -1 / (8 * far) + 1 / (192 * F.pow(far, 3)) - 1 / (640 * F.pow(far, 5)) + 17 / (14336 * F.pow(far, 7))
    down = F.aggregate(
        F.sequence(F.lit(0), F.lit(19)), F.lit(1.0), lambda r, k: r * (a + k.cast("double")) / (a + k.cast("double") + 0.5)
    )
    gammas = F.sqrt(far) * F.exp(series) * down
    front = F.exp(-a * F.log1p(y)) * F.sqrt(rest) * gammas / math.sqrt(math.pi)
    tail, head = front * _beta_fraction(x, rest, a, half), front * _beta_fraction(rest, x, half, a)
    return F.when(y > 1e300, F.lit(0.0)).when(x < (a + 1) / (a + 2.5), tail).otherwise(1 - head)


def welch_tests(
    df: DataFrame, phase: str, values: Sequence[str], *, order: Sequence[str] | None = None, p_values: bool = True
) -> DataFrame:
    """Welch's t for each pair of phases and each value column.

    The rows are reduced to moments per phase first; pairs are made from those few rows.
    """
    long = to_long(df, [phase], {v: v for v in values}, "variable", "value")
    moments = (
        long.where(F.col("value").isNotNull() & col(phase).isNotNull())
        .groupBy("variable", col(phase).alias("phase"))
        .agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("value").alias("n"))
        .where("n > 1")
    )
    place = F.col("phase")
    if order is not None:
        place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("phase"))
    moments = moments.withColumn("k", place)
    a, b = moments.alias("a"), moments.alias("b")
    pairs = a.join(b, (F.col("a.variable") == F.col("b.variable")) & (F.col("a.k") < F.col("b.k")))
    sa, sb = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    spread = sa + sb
    out = pairs.select(
        F.col("a.variable").alias("variable"),
        F.col("a.phase").alias("phase_a"),
        F.col("b.phase").alias("phase_b"),
        F.try_divide(F.col("a.m") - F.col("b.m"), F.nullif(F.sqrt(spread), F.lit(0.0))).alias("t"),
        F.try_divide(
            spread * spread,
            F.nullif(sa * sa / (F.col("a.n") - 1) + sb * sb / (F.col("b.n") - 1), F.lit(0.0)),
        ).alias("df"),
    )
    if not p_values:
        return out
    return out.withColumn("p", student_p(F.col("t"), F.col("df"))).withColumn("significant", F.col("p") < 0.05)


def on_off_means(df: DataFrame, flags: dict[str, str], values: Sequence[str]) -> DataFrame:
    """Mean with the flag at 1 (OFF) and 0 (ON) and the relative change, per value and flag."""
    wide = df.agg(
        *[
            F.avg(F.when(col(f) == at, col(v))).alias(f"m_{i}_{j}_{at}")
            for i, v in enumerate(values)
            for j, f in enumerate(flags.values())
            for at in (0, 1)
        ]
    )
    cells = [
        {
            "variable": F.lit(v),
            "chemical": F.lit(name),
            "off_mean": F.col(f"m_{i}_{j}_1"),
            "on_mean": F.col(f"m_{i}_{j}_0"),
        }
        for i, v in enumerate(values)
        for j, name in enumerate(flags)
    ]
    out = wide.select(_rows(cells).alias("c")).select("c.*")
    return out.withColumn(
        "change_pct", ratio(F.lit(100.0) * (F.col("off_mean") - F.col("on_mean")), "on_mean")
    )


def phase_extent(df: DataFrame, phase: str, day: str) -> DataFrame:
    return df.where(col(phase).isNotNull()).groupBy(col(phase).alias("phase")).agg(
        F.count(F.lit(1)).alias("n"), F.min(col(day)).alias("first_day"), F.max(col(day)).alias("last_day")
    )


def box_summary(df: DataFrame, phase: str, value: str, *, stored: bool = False) -> DataFrame:
    """Quartiles, mean ± SD per phase, and whether a log axis is advised for the whole column.

    One search finds the ranks of each phase and of the whole, and one aggregate the rest. Rows without a phase count for
    the whole only.
    """
    have = df.select(col(value).cast("double").alias("v"), col(phase).alias("phase"))
    quart = exact_quantiles(have, "v", [0.25, 0.5, 0.75], by=["phase"], names=["q1", "median", "q3"], stored=stored, overall="all")
    basic = have.groupBy("phase").agg(
        F.count("v").alias("n"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("sd"),
    )
    found = quart.withColumnRenamed("phase", "of")
    each = basic.join(found, F.col("phase").eqNullSafe(F.col("of")) & ~F.col("all"), "full")
    once = Window.partitionBy(F.lit(0))  # a row a phase
    log_axis = F.max("high").over(once) > 10 * F.max(F.when(F.col("all"), F.col("median"))).over(once)
    return (
        each.withColumn("log_axis", log_axis)
        .where("phase IS NOT NULL")
        .select("phase", "n", "low", "q1", "median", "q3", "high", "mean", "sd", "log_axis")
    )


def axis_range(df: DataFrame, value: str, *, stored: bool = False) -> DataFrame:
    """Focused range (2 % to 98 % padded by 8 %; NULL without spread) and whether a log axis is allowed."""
    ends = exact_quantiles(df, value, [0.02, 0.98], names=["lo", "hi"], stored=stored)
    lowest = df.agg(F.min(col(value).cast("double")).alias("m"))
    pad = (F.col("hi") - F.col("lo")) * 0.08
    wide = F.col("hi") > F.col("lo")
    # both sides have one row
    return lowest.join(F.broadcast(ends), F.lit(True), "left").select(
        F.when(wide, F.col("lo") - pad).alias("range_low"),
        F.when(wide, F.col("hi") + pad).alias("range_high"),
        F.coalesce(F.col("m") > 0, F.lit(False)).alias("log_allowed"),
    )


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum; empty bins are present with 0."""
    v = col(value).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where(F.col("lo").isNotNull())
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(
        F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1))
    ).otherwise(0)
    filled = (
        df.where(v.isNotNull())
        .crossJoin(F.broadcast(ends))  # one row
        .groupBy(place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("w"))
    return frame.join(filled, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def hour_and_weekday_profile(
    df: DataFrame, condition: Column, ts: str, values: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Counts, means and maxima of the rows that meet a condition, by hour and by weekday (Monday = 0)."""
    rows = df.where(condition)
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        aggs += [F.avg(col(v)).alias(f"{v}_mean"), F.max(col(v)).alias(f"{v}_max")]
    t = col(ts).cast("timestamp")
    return rows.groupBy(F.hour(t).alias("hour")).agg(*aggs), rows.groupBy(F.weekday(t).alias("weekday")).agg(*aggs)
