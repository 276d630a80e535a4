"""Hourly, daily, monthly and weekday roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import col, numeric_names, present
from sensorloom.functions.timekit import as_time, bin_end, bin_start, local_date, monday_weekday
from sensorloom.operators.grid import on_grid

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def hour_ending(
    df: DataFrame,
    ts: str,
    *,
    sums: dict[str, str] | None = None,
    means: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Bins ``(h - 1, h]`` labelled ``h``; every hour is present and an empty sum is 0.

    The dicts map output name to column name.
    """
    sums, means, maxima = sums or {}, means or {}, maxima or {}
    hourly = df.groupBy(*[col(k) for k in keys], bin_end(ts, 60).alias(ts)).agg(
        *[F.sum(col(c)).alias(n) for n, c in sums.items()],
        *[F.avg(col(c)).alias(n) for n, c in means.items()],
        *[F.max(col(c)).alias(n) for n, c in maxima.items()],
    )
    ends = df.select(*[col(k) for k in keys], bin_end(ts, 60).alias(ts))
    full = on_grid(hourly, ts, keys=keys, minutes=60, source=ends)
    return full.withColumns({n: F.coalesce(col(n), F.lit(0.0)) for n in sums}) if sums else full


def plant_hourly(df: DataFrame, ts: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Hour-ending flow, volatile load, ferric demand and gas levels of a table with load columns."""
    gas = {plant.H2S: "max", plant.NH3: "mean", plant.TEMP_NH3: "mean", plant.TEMP_H2S: "mean"}
    have = present(df, gas)
    out = hour_ending(
        df,
        ts,
        sums={"flow_gal_hr": "total_gpm", "lbs_volatile": "lbs_per_min"},
        means={c: c for c in have if gas[c] == "mean"},
        maxima={c: c for c in have if gas[c] == "max"},
        keys=keys,
    )
    ids = [*keys, ts, "flow_gal_hr", "lbs_volatile"]
    demand = (F.col("lbs_volatile") / F.lit(plant.FERRIC_DEMAND_DIVISOR)).alias("fecl3_lbs")
    return out.select(*[col(i) for i in ids], demand, *[col(c) for c in have])


def hour_starting(
    df: DataFrame,
    ts: str,
    *,
    means: Sequence[str] = (),
    maxima: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Bins ``[h, h + 1)`` labelled ``h``; bins without any value are dropped."""
    out = df.groupBy(*[col(k) for k in keys], bin_start(ts, 60).alias(ts)).agg(
        *[F.avg(col(c)).alias(c) for c in means], *[F.max(col(c)).alias(c) for c in maxima]
    )
    return out.dropna(how="all", subset=[f"`{c}`" for c in (*means, *maxima)])


def hourly_peak_flow(df: DataFrame, ts: str, parts: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Hourly maximum of the summed running totals, in gallons and MGD; empty hours are dropped."""
    total = sum((F.coalesce(col(p).try_cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0))
    return (
        df.groupBy(*[col(k) for k in keys], bin_start(ts, 60).alias(ts))
        .agg(F.max(total).alias("flow_gal"))
        .dropna(subset=["flow_gal"])
        .withColumn("flow_mgd", F.col("flow_gal") / F.lit(1_000_000.0))
    )


def local_daily(
    df: DataFrame,
    ts: str,
    *,
    means: Sequence[str] = (),
    maxima: Sequence[str] = (),
    keys: Sequence[str] = (),
    zone: str = "US/Eastern",
    day: str = "local_date",
) -> DataFrame:
    """Daily means and maxima by local calendar date of UTC instants."""
    return df.groupBy(*[col(k) for k in keys], local_date(ts, zone).alias(day)).agg(
        *[F.avg(col(c)).alias(c) for c in means], *[F.max(col(c)).alias(c) for c in maxima]
    )


def daily_means(df: DataFrame, ts: str, *, keys: Sequence[str] = (), day: str = "day") -> DataFrame:
    """Daily mean of all numeric columns."""
    names = [n for n in numeric_names(df) if n not in keys]
    return df.groupBy(*[col(k) for k in keys], F.to_date(as_time(ts)).alias(day)).agg(
        *[F.avg(col(n)).alias(n) for n in names]
    )


def daily_table(
    df: DataFrame,
    ts: str,
    *,
    aggregates: dict[str, Column],
    counts: dict[str, str],
    expected: int = 1440,
    keys: Sequence[str] = (),
    day: str = "day",
) -> DataFrame:
    """One aggregate per day with observation counts and coverage.

    ``counts`` maps a label to a column; ``n_obs_<label>`` and ``<label>_coverage``
    are added, and days without any observation are dropped. Without counts, days
    that are empty in every column are dropped.
    """
    n_obs = {f"n_obs_{label}": F.count(col(c)) for label, c in counts.items()}
    out = df.groupBy(*[col(k) for k in keys], F.to_date(as_time(ts)).alias(day)).agg(
        *[a.alias(n) for n, a in {**aggregates, **n_obs}.items()]
    )
    if not counts:
        return out.dropna(how="all", subset=[f"`{n}`" for n in aggregates])
    out = out.withColumns({f"{label}_coverage": F.col(f"n_obs_{label}") / F.lit(float(expected)) for label in counts})
    return out.where(sum((F.col(n) for n in n_obs), F.lit(0)) > 0)


def plant_daily(df: DataFrame, ts: str, *, keys: Sequence[str] = (), day: str = "day") -> DataFrame:
    """The plant's daily table from whatever minute columns exist."""
    levels = [plant.EAST, plant.WEST, plant.DIGESTER, plant.COMBINED]
    doses = [f"{chem}_{kind}_lbs_per_day" for chem in ("ferric", "hcl") for kind in ("solution", "active")]
    how = {
        plant.NH3: F.avg,
        plant.H2S: F.max,
        **dict.fromkeys(levels, F.avg),
        **dict.fromkeys(plant.STATES.values(), F.max),
        "interp_flag": F.sum,
        **dict.fromkeys(doses, F.avg),
    }
    aggregates = {c: how[c](col(c)) for c in present(df, how)}
    for label, c in (("h2s", plant.H2S), ("nh3", plant.NH3)):
        if c in df.columns:
            aggregates[f"{label}_std"] = F.stddev_samp(col(c))
    counts = {label: c for label, c in (("nh3", plant.NH3), ("h2s", plant.H2S)) if c in df.columns}
    water = present(df, [plant.COMBINED, plant.EAST, plant.WEST])
    if water:
        counts["water"] = water[0]
    if present(df, levels):
        total = sum((F.coalesce(col(c), F.lit(0.0)) for c in present(df, plant.FLOWS)), F.lit(0.0))
        aggregates["total_gpm"] = F.avg(total)
        aggregates["transferred_lbs_vol_daily"] = F.sum(total * F.lit(plant.LBS_PER_GAL))
    return daily_table(df, ts, aggregates=aggregates, counts=counts, keys=keys, day=day)


def _period_means(daily: DataFrame, period: Column, name: str, suffix: str, columns, keys, day) -> DataFrame:
    skip = {*keys, day}
    names = list(columns) if columns is not None else [n for n in numeric_names(daily) if n not in skip]
    renamed = {
        plant.NH3: f"nh3_{suffix}",
        plant.H2S: f"h2s_{suffix}",
        "total_gpm": f"total_gpm_{suffix}",
        "transferred_lbs_vol_daily": f"transferred_lbs_vol_{suffix}",
    }
    return daily.groupBy(*[col(k) for k in keys], period.alias(name)).agg(
        *[F.avg(col(n)).alias(renamed.get(n, n)) for n in names], F.count(F.lit(1)).alias("days_in_data")
    )


def month_summary(
    daily: DataFrame, day: str = "day", *, columns: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean of daily values by month number; years merge."""
    return _period_means(daily, F.month(col(day)), "month", "monthly_mean", columns, keys, day)


def weekday_summary(
    daily: DataFrame, day: str = "day", *, columns: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean of daily values by weekday (Monday = 0), named from the number."""
    out = _period_means(daily, monday_weekday(day), "weekday", "weekday_mean", columns, keys, day)
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    return out.withColumn("weekday_name", F.element_at(names, F.col("weekday") + 1))


def month_label(month: str | Column) -> Column:
    """Short English name of a month number; other numbers stay as text."""
    m = col(month).cast("int")
    return F.when(m.between(1, 12), F.monthname(F.make_date(F.lit(2000), m, F.lit(1)))).otherwise(m.cast("string"))
