"""Minute features: lags, rolling windows, z-scores, calendar, interactions, targets, flags."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import col, present
from sensorloom.functions.timekit import as_time, minutes_between, monday_weekday, shift_minutes
from sensorloom.operators.windows import carry, rolling_stats, with_halo


def lag_and_roll(
    df: DataFrame,
    ts: str,
    signals: dict[str, str],
    *,
    lags: Sequence[int] = tuple(plant.LAGS_MIN),
    rolls: Sequence[int] = tuple(plant.ROLLS_MIN),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Lags and rolling mean/max (at least one value) on the minute grid; all frames share one sort.

    ``signals`` maps the name prefix to the column.
    """

    def make(w) -> dict[str, Column]:
        out = {}
        for prefix, c in signals.items():
            for n in lags:
                out[f"{prefix}_lag_{n}min"] = F.lag(col(c), n).over(w)
            for n in rolls:
                frame = w.rowsBetween(-(n - 1), 0)
                out[f"{prefix}_roll_mean_{n}min"] = F.avg(col(c)).over(frame)
                out[f"{prefix}_roll_max_{n}min"] = F.max(col(c)).over(frame)
        return out

    reach = max([*lags, *[n - 1 for n in rolls], 1])
    return with_halo(df, ts, make, keys=keys, before=reach)


def drop_warmup(df: DataFrame, ts: str, minutes: int = max(plant.LAGS_MIN), *, keys: Sequence[str] = ()) -> DataFrame:
    """Drop the first ``minutes`` grid rows of every series."""
    first = df.groupBy(*[col(k) for k in keys]).agg(F.min(as_time(ts)).alias("__first"))
    joined = df.join(first, list(keys)) if keys else df.crossJoin(F.broadcast(first))  # one row without keys
    return joined.where(as_time(ts) >= shift_minutes("__first", minutes)).drop("__first")


def rolling_by_rows(df: DataFrame, order: str, columns: Sequence[str], rows: int, *, keys: Sequence[str] = (),
                    suffix: str = "_smooth") -> DataFrame:
    """Mean of the last few rows of a daily table (one partition per key: rows are days)."""
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(order)).rowsBetween(-(rows - 1), 0)
    return df.withColumns({f"{c}{suffix}": F.avg(col(c)).over(w) for c in columns})


def zscore(
    df: DataFrame, ts: str, value: str, window: int = 1440, *, keys: Sequence[str] = (), name: str = "z_score"
) -> DataFrame:
    """Deviation from the rolling mean in rolling standard deviations.

    NULL with fewer than ``max(10, window // 10)`` values or without spread.
    """
    rolled = rolling_stats(df, ts, value, window, keys=keys, prefix="__r_")
    enough = F.col("__r_count") >= max(10, window // 10)
    score = F.try_divide(col(value) - F.col("__r_mean"), F.nullif(F.col("__r_sd"), F.lit(0.0)))
    return rolled.withColumn(name, F.when(enough, score)).drop("__r_count", "__r_mean", "__r_sd")


def anomalies(
    df: DataFrame, ts: str, value: str, *, threshold: float = 3.0, window: int = 1440, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows whose absolute z-score reaches the threshold (sort at the sink with ``by_severity``)."""
    return zscore(df, ts, value, window, keys=keys).where(F.abs(F.col("z_score")) >= threshold)


def by_severity(found: DataFrame, ts: str, *, ties: Sequence[str] = ()) -> DataFrame:
    """Largest deviation first, then the earliest, then by ``ties``."""
    return found.orderBy(F.abs(F.col("z_score")).desc(), col(ts), *[col(c) for c in ties])


def calendar(df: DataFrame, ts: str) -> DataFrame:
    t = as_time(ts)
    minute_of_day = F.hour(t) * 60 + F.minute(t)
    turn = F.lit(2 * math.pi)
    return df.withColumns(
        {
            "hour": F.hour(t),
            "minute": F.minute(t),
            "dayofweek": monday_weekday(t),
            "dayofyear": F.dayofyear(t),
            "month": F.month(t),
            "is_weekend": (monday_weekday(t) >= 5).cast("int"),
            "hour_sin": F.sin(turn * minute_of_day / 1440),
            "hour_cos": F.cos(turn * minute_of_day / 1440),
            "dow_sin": F.sin(turn * monday_weekday(t) / 7),
            "dow_cos": F.cos(turn * monday_weekday(t) / 7),
        }
    )


def interactions(
    df: DataFrame,
    *,
    states: dict[str, str] | None = None,
    temperatures: dict[str, str] | None = None,
    gases: dict[str, str] | None = None,
) -> DataFrame:
    """Products of flow, load, temperature with availability, and of gas with flow."""
    states = states or {"hcl": plant.STATES["HCl"], "ferric": plant.STATES["Ferric"]}
    temperatures = temperatures or {"temp_nh3": plant.TEMP_NH3, "temp_h2s": plant.TEMP_H2S}
    gases = gases or {"nh3": plant.NH3, "h2s": plant.H2S}
    factors = {"flow": "total_gpm", "load": "lbs_per_min", **temperatures}
    made = {}
    for prefix, c in factors.items():
        if c in df.columns:
            for s, state in states.items():
                made[f"{prefix}_x_{s}"] = col(c) * (col(state) if state in df.columns else F.lit(0))
    for prefix, c in gases.items():
        if c in df.columns:
            made[f"{prefix}_x_flow"] = col(c) * col("total_gpm")
    return df.withColumns(made)


def state_now(state: str | Column) -> Column:
    return F.coalesce(col(state).cast("int"), F.lit(0))


def change_marks(states: dict[str, str], previous: dict[str, Column], ts: str) -> dict[str, Column]:
    """Row time where a state went ON, went OFF, or changed; a first row counts as a change."""
    marks = {}
    for s, c in states.items():
        step = state_now(c) - previous[s]
        since = f"minutes_since_{s.lower()}"
        marks[f"{since}_on"] = F.when(step == 1, col(ts))
        marks[f"{since}_off"] = F.when(step == -1, col(ts))
        marks[f"{since}_state_change"] = F.when(F.coalesce(step != 0, F.lit(True)), col(ts))
    return marks


def minutes_since_changes(
    df: DataFrame, ts: str, states: dict[str, str] | None = None, *, keys: Sequence[str] = ()
) -> DataFrame:
    """Minutes since the last ON, OFF and change of each state, NULL before the first.

    Two carries for all states together: previous state, then last event times.
    """
    states = {k: v for k, v in (states or plant.STATES).items() if v in df.columns}
    if not states:
        return df
    before = {f"__prev_{s}": state_now(c) for s, c in states.items()}
    with_prev = carry(df, ts, last=before, keys=keys, exclusive=True)
    marks = change_marks(states, {s: F.col(f"__prev_{s}") for s in states}, ts)
    out = carry(with_prev, ts, last=marks, keys=keys)
    return out.select(*[col(n) for n in df.columns], *[minutes_between(m, ts).alias(m) for m in marks])


def leads(df: DataFrame, columns: Sequence[str], horizons: Sequence[int], w) -> dict[str, Column]:
    """``<column>_t_plus_<h>min`` on a grid window; an absent column gives nulls."""
    have = set(df.columns)
    return {
        f"{c}_t_plus_{h}min": F.lead(col(c), h).over(w) if c in have else F.lit(None).cast("double")
        for h in horizons
        for c in columns
    }


def target_columns(
    df: DataFrame, gases: dict[str, str], horizons: Sequence[int], limits: dict[str, float]
) -> DataFrame:
    """Change from now and limit exceedance of the led columns; a missing target exceeds nothing."""
    made = {}
    for h in horizons:
        for g, c in gases.items():
            target = col(f"{c}_t_plus_{h}min")
            made[f"{g}_delta_{h}min"] = target - col(c)
            made[f"{g}_exceeds_{limits[g]:.1f}_ppm_t_plus_{h}min"] = F.coalesce(
                (target >= limits[g]).cast("int"), F.lit(0)
            )
    return df.withColumns(made)


GASES = {"nh3": plant.NH3, "h2s": plant.H2S}


def future_targets(
    df: DataFrame,
    ts: str,
    *,
    gases: dict[str, str] | None = None,
    raw: Sequence[str] = (plant.RAW_NH3, plant.RAW_H2S),
    horizons: Sequence[int] = tuple(plant.HORIZONS_MIN),
    limits: dict[str, float] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Values at the horizons, their change from now, and limit exceedance."""
    gases = gases or GASES
    led = [*gases.values(), *raw]
    out = with_halo(df, ts, lambda w: leads(df, led, horizons, w), keys=keys, after=max(horizons))
    return target_columns(out, gases, horizons, limits or plant.LIMITS)


def quality_flags(
    df: DataFrame,
    *,
    gases: Sequence[str] = (plant.NH3, plant.H2S),
    required: Sequence[str] = ("total_gpm", "lbs_per_min", plant.COMBINED, plant.WEST, plant.EAST),
    horizons: Sequence[int] = tuple(plant.HORIZONS_MIN),
) -> DataFrame:
    def every(names) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & col(n).isNotNull()
        return out

    some = F.lit(False)
    for g in gases:
        some = some | col(g).isNotNull()
    have = present(df, required)
    valid = F.coalesce(col("sensor_valid").cast("int"), F.lit(0)) if "sensor_valid" in df.columns else F.lit(0)
    complete = every(have) if have else F.lit(False)
    made = {
        "gas_data_available": some.cast("int"),
        "both_gas_signals_available": every(gases).cast("int"),
        "sensor_valid_flag": valid,
        "feature_row_complete": complete.cast("int"),
    }
    for h in horizons:
        ready = every([f"{g}_t_plus_{h}min" for g in gases])
        made[f"target_ready_{h}min"] = ready.cast("int")
        made[f"model_row_valid_{h}min"] = (complete & (valid == 1) & ready).cast("int")
    return df.withColumns(made)


def first_to_last_change(value: str | Column, ts: str | Column) -> Column:
    """Aggregate: last minus first non-null value, NULL with fewer than two."""
    v = col(value)
    at = F.when(v.isNotNull(), as_time(ts))
    return F.when(F.count(v) >= 2, F.max_by(v, at) - F.min_by(v, at))


def first_exceedance(
    df: DataFrame, ts: str, value: str, limit: float | Column, *, days: int = 2, keys: Sequence[str] = ()
) -> DataFrame:
    """First time a signal is above a limit, and the end of the window that starts there."""
    bound = limit if isinstance(limit, Column) else F.lit(float(limit))
    start = F.min(F.when(col(value) > bound, as_time(ts)))
    grouped = df.groupBy(*[col(k) for k in keys]).agg(start.alias("start_ts"))
    return grouped.withColumn("end_ts", shift_minutes("start_ts", days * 1440))
