"""Loads, chemical doses, water chemistry and dated operating flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import col, present
from sensorloom.functions.numeric import active_lbs, dose_mgl, number, ratio, unit_interval
from sensorloom.functions.timekit import as_time, between_closed, working_hours
from sensorloom.operators.windows import forward_fill


def in_window(ts: str | Column, start: str | None, end: str | None) -> Column:
    """``start <= ts < end``; a missing end leaves the window open."""
    t = as_time(ts)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (t >= F.lit(start).cast("timestamp"))
    if end is not None:
        inside = inside & (t < F.lit(end).cast("timestamp"))
    return inside


def dated_value(ts: str | Column, default, windows: Sequence[tuple]) -> Column:
    """Default value, replaced inside half-open dated windows."""
    out = F
    for start, end, value in windows:
        out = out.when(in_window(ts, start, end), F.lit(value))
    return out.otherwise(F.lit(default)) if windows else F.lit(default)


def operating_flags(df: DataFrame, ts: str, calendar: dict | None = None) -> DataFrame:
    """Dated availability flags and the weekday working-hours proxy."""
    flags = {n: dated_value(ts, d, w) for n, (d, w) in (calendar or plant.CALENDAR).items()}
    return df.withColumns({**flags, "truck_activity_proxy": working_hours(ts)})


def closed_flag(ts: str | Column, start: str, end: str) -> Column:
    """1 inside a window with both ends inclusive."""
    return F.coalesce(between_closed(ts, start, end).cast("int"), F.lit(0))


def phase(day: str | Column, phases: Sequence[tuple[str, str | None]] | None = None) -> Column:
    """Phase label by date cut points; NULL date gives NULL."""
    d = F.to_date(col(day))
    out = F
    for label, end in phases or plant.PHASES:
        inside = d.isNotNull() if end is None else d < F.lit(end).cast("date")
        out = out.when(inside, F.lit(label))
    return out


def loads(df: DataFrame, ts: str, *, flows: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Fill the flows, then total flow, volatile load and gas per load."""
    flows = list(flows or plant.FLOWS)
    have = present(df, flows)
    df = df.withColumns({c: number(c) if c in have else F.lit(0.0) for c in flows})
    df = forward_fill(df, ts, have, keys=keys, default=0.0)
    return load_columns(df, flows)


def load_columns(df: DataFrame, flows: Sequence[str]) -> DataFrame:
    total = sum((col(c) for c in flows), F.lit(0.0))
    df = df.withColumn("total_gpm", total)
    df = df.withColumn("lbs_per_min", F.col("total_gpm") * F.lit(plant.LBS_PER_GAL))
    per_lb = F.col("lbs_per_min") + F.lit(plant.PER_LB_EPSILON)
    gases = {"nh3_per_lb": plant.NH3, "h2s_per_lb": plant.H2S}
    return df.withColumns({n: col(c) / per_lb for n, c in gases.items() if c in df.columns})


def enrich(df: DataFrame, ts: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Loads, combined flow, load alias, and dose columns where a flag exists without them."""
    out = loads(df, ts, keys=keys)
    if plant.COMBINED not in out.columns:
        out = out.withColumn(plant.COMBINED, sum((col(c) for c in plant.FLOWS), F.lit(0.0)))
    out = out.withColumn("transferred_lbs_vol", F.col("lbs_per_min"))
    if "ferric_available" in out.columns and "ferric_active_lbs_per_day" not in out.columns:
        out = ferric_dose(out, ts)
    if "hcl_available" in out.columns and "hcl_active_lbs_per_day" not in out.columns:
        out = hcl_dose(out)
    return out


def load_per_hour(gpm: str | Column) -> Column:
    """Volatile pounds per hour of one flow; a missing flow counts as 0."""
    return F.coalesce(col(gpm), F.lit(0.0)) * F.lit(60.0) * F.lit(plant.LBS_PER_GAL)


def ferric_demand(load: str | Column) -> Column:
    return col(load) / F.lit(plant.FERRIC_DEMAND_DIVISOR)


def _dose(df: DataFrame, chem: str, state: str, full: Column, strength: float, gravity: float) -> DataFrame:
    solution, active = f"{chem}_solution_lbs_per_day", f"{chem}_active_lbs_per_day"
    if state not in df.columns:
        none = F.lit(None).cast("double")
        return df.withColumns({solution: none, active: none})
    df = df.withColumn(solution, unit_interval(state) * full)
    return df.withColumns(
        {
            active: active_lbs(solution, strength),
            f"{chem}_strength_frac": F.lit(strength),
            f"{chem}_specific_gravity": F.lit(gravity),
        }
    )


def ferric_dose(
    df: DataFrame,
    ts: str,
    *,
    state: str = "ferric_available",
    solution_lbs: float = plant.FERRIC_SOLUTION_LBS,
    strength: float = plant.FERRIC_STRENGTH,
    halved_from: str = plant.FERRIC_CUT,
) -> DataFrame:
    full = F.lit(solution_lbs) * F.when(in_window(ts, halved_from, None), 0.5).otherwise(1.0)
    return _dose(df, "ferric", state, full, strength, plant.FERRIC_GRAVITY)


def hcl_dose(
    df: DataFrame,
    *,
    state: str = "hcl_available",
    solution_lbs: float = plant.HCL_SOLUTION_LBS,
    strength: float = plant.HCL_STRENGTH,
) -> DataFrame:
    return _dose(df, "hcl", state, F.lit(solution_lbs), strength, plant.HCL_GRAVITY)


def dated_dose_mgl(ts: str | Column, mgd: str | Column, solution_lbs: float, strength: float, off: Sequence[tuple]) -> Column:
    """mg/L of a constant feed that is 0 inside the OFF windows; NULL without a positive flow."""
    feed = dated_value(ts, solution_lbs * strength, [(a, b, 0.0) for a, b in off])
    return dose_mgl(feed, mgd)


def gas_per_dose(gas: str | Column, dose: str | Column) -> Column:
    return ratio(gas, dose)


# ---------------------------------------------------------- water chemistry
def ion_totals(samples: DataFrame, *, conc: str, charge: str, by: Sequence[str] = ()) -> DataFrame:
    """Ionic strength, cation and anion totals and charge balance per group of ion rows."""
    c, z = col(conc).cast("double"), F.coalesce(col(charge).cast("double"), F.lit(0.0))
    out = samples.groupBy(*[col(b) for b in by]).agg(
        (F.lit(0.5) * F.sum(c * z * z)).alias("ionic_strength_M"),
        F.coalesce(F.sum(F.when(z > 0, c)), F.lit(0.0)).alias("total_cations_M"),
        F.coalesce(F.sum(F.when(z < 0, c)), F.lit(0.0)).alias("total_anions_M"),
        F.sum(c * z).alias("charge_balance_eq_per_L"),
    )
    whole = F.abs(F.col("total_cations_M")) + F.abs(F.col("total_anions_M"))
    return out.withColumn("charge_balance_ratio", ratio("charge_balance_eq_per_L", whole))


def fixed_chemistry(df: DataFrame, ions: Sequence[tuple[str, float, int]] | None = None, ph: float = plant.PH) -> DataFrame:
    """Constant chemistry columns; plan-time literals, so no join is needed."""
    ions = list(ions or plant.IONS)
    cations = sum(c for _, c, z in ions if z > 0)
    anions = sum(c for _, c, z in ions if z < 0)
    net = sum(c * z for _, c, z in ions)
    whole = abs(cations) + abs(anions)
    constants = {
        "pH_fixed": ph,
        **{f"fixed_ion_{s}_M": c for s, c, _ in ions},
        "ionic_strength_M": sum(c * z * z for _, c, z in ions) / 2,
        "fixed_total_cations_M": cations,
        "fixed_total_anions_M": anions,
        "fixed_charge_balance_eq_per_L": net,
        "fixed_charge_balance_ratio": net / whole if whole else None,
    }
    return df.withColumns({n: F.lit(v).cast("double") for n, v in constants.items()})
