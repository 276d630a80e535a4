"""Scalar expressions: coercion, unit conversion, safe statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import col


def number(c: str | Column) -> Column:
    """Double, with bad text and NaN as NULL."""
    return F.nanvl(col(c).try_cast("double"), F.lit(None).cast("double"))


def flag(c: str | Column) -> Column:
    """0/1 integer with NULL and bad text as 0."""
    return F.coalesce(number(c), F.lit(0.0)).cast("int")


def unit_interval(c: str | Column) -> Column:
    """NULL as 0, then clipped to [0, 1]."""
    return F.least(F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def ratio(num: str | Column, den: str | Column) -> Column:
    """Quotient as double; zero or NULL denominator gives NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


# ------------------------------------------------------------------ dosing
def lbs_from_mgl(mgl: str | Column, mgd: str | Column) -> Column:
    return col(mgd).cast("double") * F.lit(plant.LB_PER_MGAL_MGL) * col(mgl).cast("double")


def mgl_from_lbs(lbs: str | Column, mgd: str | Column) -> Column:
    return ratio(lbs, col(mgd).cast("double") * F.lit(plant.LB_PER_MGAL_MGL))


def active_lbs(solution_lbs: str | Column, strength: float) -> Column:
    return col(solution_lbs).cast("double") * F.lit(float(strength))


def mgd_from_gpm(gpm: str | Column) -> Column:
    return col(gpm).cast("double") * F.lit(1440.0) / F.lit(1_000_000.0)


def dose_mgl(lbs: str | Column, mgd: str | Column) -> Column:
    """Dose intensity; NULL without a positive flow."""
    flow = col(mgd)
    return F.when(flow > 0, mgl_from_lbs(lbs, flow))


def dose_mgl_from_gpm(lbs: str | Column, gpm: str | Column) -> Column:
    return dose_mgl(lbs, mgd_from_gpm(gpm))


# -------------------------------------------------------------- statistics
def pearson(a: str | Column, b: str | Column) -> Column:
    """Pairwise-complete correlation; NULL when either side is constant.

    ``corr`` raises on a constant column under ANSI. Both regression slopes are
    NULL there, share the pairing of nulls, and their product is the squared correlation.
    """
    x, y = col(a).cast("double"), col(b).cast("double")
    up, across = F.regr_slope(y, x), F.regr_slope(x, y)
    return F.signum(up) * F.sqrt(up * across)


def error_metrics(truth: str | Column, guess: str | Column) -> dict[str, Column]:
    """MAE, RMSE and R² as aggregate expressions."""
    y, p = col(truth), col(guess)
    e = F.when(y.isNotNull(), y - p)
    mse = F.avg(e * e)
    return {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(mse),
        "r2": F.lit(1.0) - F.try_divide(mse, F.var_pop(F.when(p.isNotNull(), y))),
    }


def limit_metrics(truth: str | Column, guess: str | Column, limit: float) -> dict[str, Column]:
    """Accuracy, precision and recall of ``>= limit``; undefined ratios are NULL."""
    t = F.coalesce(col(truth) >= limit, F.lit(False))
    p = F.coalesce(col(guess) >= limit, F.lit(False))

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    hits = n(t & p)
    return {
        "accuracy": F.try_divide(n(t == p).cast("double"), F.count(F.lit(1))),
        "precision": F.try_divide(hits.cast("double"), n(p)),
        "recall": F.try_divide(hits.cast("double"), n(t)),
    }
