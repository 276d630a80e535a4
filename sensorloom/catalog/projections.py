"""Loads, doses, chemistry, calendar, flags, the modeling table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.catalog.base import Catalog, site_minutes, sql, table
from sensorloom.functions.numeric import (
    active_lbs,
    dose_mgl_from_gpm,
    lbs_from_mgl,
    mgl_from_lbs,
)
from sensorloom.operators import dosing, features
from sensorloom.plans.build import modeling_metadata, modeling_table

CATALOG = Catalog()
add = CATALOG.add

_FLOWS = "west_sludge_out_gpm east_sludge_out_gpm digesters_sludge_out_flow"
_LOADS = f"{_FLOWS} total_gpm lbs_per_min nh3_per_lb h2s_per_lb"
_COMMA = ", ".join


@add("operational_loads", sql(f"SELECT ts, {_COMMA(_LOADS.split())} FROM loaded", "loaded", _LOADS))
def operational_loads(spark, d):
    return dosing.loads(site_minutes(spark, d), "ts").select("ts", *_LOADS.split())


_DOSES = """coalesce(ferric_available, 0) * 583.0::DOUBLE AS ferric_solution_lbs_per_day,
  coalesce(ferric_available, 0) * 583.0::DOUBLE * 0.379::DOUBLE AS ferric_active_lbs_per_day,
  coalesce(hcl_available, 0) * 6230.0::DOUBLE AS hcl_solution_lbs_per_day,
  coalesce(hcl_available, 0) * 6230.0::DOUBLE * 0.32::DOUBLE AS hcl_active_lbs_per_day"""
_DOSE_NAMES = "ferric_solution_lbs_per_day ferric_active_lbs_per_day hcl_solution_lbs_per_day hcl_active_lbs_per_day"


@add(
    "enriched_minutes",
    sql(
        f"""SELECT ts, total_gpm AS east_sludge_out_gpm_combined, lbs_per_min AS transferred_lbs_vol, {_DOSES},
              0.379::DOUBLE AS ferric_strength_frac, 1.16::DOUBLE AS hcl_specific_gravity FROM loaded""",
        "loaded",
        f"east_sludge_out_gpm_combined transferred_lbs_vol {_DOSE_NAMES}",
    ),
)
def enriched_minutes(spark, d):
    return dosing.enrich(site_minutes(spark, d), "ts").select(
        "ts", plant.COMBINED, "transferred_lbs_vol", *_DOSE_NAMES.split(), "ferric_strength_frac", "hcl_specific_gravity"
    )


@add(
    "hourly_load_and_demand",
    sql(
        """SELECT l_orderkey, l_linenumber, l_quantity * 60 * 7.596072::DOUBLE AS lbs_vol_per_hr,
             l_extendedprice / 24.3::DOUBLE AS fecl3_lbs FROM lineitem""",
        rounded="lbs_vol_per_hr fecl3_lbs",
    ),
)
def hourly_load_and_demand(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        dosing.load_per_hour("l_quantity").alias("lbs_vol_per_hr"),
        dosing.ferric_demand("l_extendedprice").alias("fecl3_lbs"),
    )


def _fixed():
    ions = plant.IONS
    cat, an = sum(c for _, c, z in ions if z > 0), sum(c for _, c, z in ions if z < 0)
    net, strength = sum(c * z for _, c, z in ions), sum(c * z * z for _, c, z in ions) / 2
    return strength, cat, an, net, net / (cat + an)


@add(
    "fixed_water_chemistry",
    sql(
        f"""SELECT o_orderkey, 7.0::DOUBLE AS "pH_fixed", 17.6::DOUBLE AS "fixed_ion_ca_2+_M", 0.038::DOUBLE AS "fixed_ion_nh4_1+_M",
              {_fixed()[0]!r}::DOUBLE AS "ionic_strength_M", {_fixed()[1]!r}::DOUBLE AS "fixed_total_cations_M",
              {_fixed()[2]!r}::DOUBLE AS "fixed_total_anions_M", {_fixed()[3]!r}::DOUBLE AS "fixed_charge_balance_eq_per_L",
              {_fixed()[4]!r}::DOUBLE AS fixed_charge_balance_ratio FROM orders""",
        rounded='"ionic_strength_M" "fixed_total_cations_M" "fixed_total_anions_M" "fixed_charge_balance_eq_per_L" '
        "fixed_charge_balance_ratio",
    ),
)
def fixed_water_chemistry(spark, d):
    out = dosing.fixed_chemistry(table(spark, d, "orders").select("o_orderkey"))
    return out.select(
        "o_orderkey", "pH_fixed", "`fixed_ion_ca_2+_M`", "`fixed_ion_nh4_1+_M`", "ionic_strength_M", "fixed_total_cations_M",
        "fixed_total_anions_M", "fixed_charge_balance_eq_per_L", "fixed_charge_balance_ratio",
    )


@add(
    "measured_ion_totals",
    sql(
        """SELECT *, charge / nullif(cat + an, 0) AS charge_balance_ratio FROM (
             SELECT l_suppkey, 0.5::DOUBLE * sum(c * z * z) AS strength, coalesce(sum(c) FILTER (z > 0), 0) AS cat,
               coalesce(sum(c) FILTER (z < 0), 0) AS an, sum(c * z) AS charge
             FROM (SELECT l_suppkey, l_quantity / 1000 AS c, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE -1 END AS z
                   FROM lineitem) GROUP BY 1)""",
        rounded="strength cat an charge charge_balance_ratio",
    ),
)
def measured_ion_totals(spark, d):
    ions = table(spark, d, "lineitem").select(
        "l_suppkey",
        (F.col("l_quantity") / 1000).alias("c"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(-1).alias("z"),
    )
    out = dosing.ion_totals(ions, conc="c", charge="z", by=["l_suppkey"])
    return out.toDF("l_suppkey", "strength", "cat", "an", "charge", "charge_balance_ratio")


@add(
    "unit_conversions",
    sql(
        """SELECT p_partkey, p_retailprice * 8.34::DOUBLE * p_size AS lbs, p_retailprice / nullif(p_size * 8.34::DOUBLE, 0) AS mgl,
             p_retailprice * 0.379::DOUBLE AS active FROM part""",
        rounded="lbs mgl active",
    ),
)
def unit_conversions(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        lbs_from_mgl("p_size", "p_retailprice").alias("lbs"),
        mgl_from_lbs("p_retailprice", "p_size").alias("mgl"),
        active_lbs("p_retailprice", 0.379).alias("active"),
    )


@add(
    "chemical_doses",
    sql(
        """SELECT o_orderkey, f AS ferric_solution_lbs_per_day, f * 0.379::DOUBLE AS ferric_active_lbs_per_day,
             h AS hcl_solution_lbs_per_day, h * 0.32::DOUBLE AS hcl_active_lbs_per_day FROM (
             SELECT o_orderkey, a * 583.0::DOUBLE * CASE WHEN o_orderdate >= '1998-01-07' THEN 0.5 ELSE 1.0 END::DOUBLE AS f,
               b * 6230.0::DOUBLE AS h
             FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 0 END AS a,
                     CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS b FROM orders))""",
        rounded=_DOSE_NAMES,
    ),
)
def chemical_doses(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey",
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 0).alias("ferric_available"),
        F.when(F.col("o_totalprice") > 250000, 1).otherwise(-1).alias("hcl_available"),
    )
    out = dosing.hcl_dose(dosing.ferric_dose(o, "o_orderdate", halved_from="1998-01-07"))
    return out.select("o_orderkey", *_DOSE_NAMES.split())


@add(
    "dose_intensity",
    sql(
        f"""SELECT ts, CASE WHEN gpm > 0 THEN fa / (gpm * 1440 / 1000000.0::DOUBLE * 8.34::DOUBLE) END AS ferric_active_mg_per_l,
              CASE WHEN gpm > 0 THEN ha / (gpm * 1440 / 1000000.0::DOUBLE * 8.34::DOUBLE) END AS hcl_active_mg_per_l
            FROM (SELECT ts, total_gpm AS gpm, ferric_active_lbs_per_day AS fa, hcl_active_lbs_per_day AS ha
                  FROM (SELECT *, {_DOSES} FROM loaded))""",
        "loaded",
        "ferric_active_mg_per_l hcl_active_mg_per_l",
    ),
)
def dose_intensity(spark, d):
    minutes = dosing.enrich(site_minutes(spark, d), "ts")
    return minutes.select(
        "ts",
        dose_mgl_from_gpm("ferric_active_lbs_per_day", "total_gpm").alias("ferric_active_mg_per_l"),
        dose_mgl_from_gpm("hcl_active_lbs_per_day", "total_gpm").alias("hcl_active_mg_per_l"),
    )


_OFF_HCL = [("1996-08-27", "1996-10-02 14:30")]
_OFF_FERRIC = [("1996-09-09 08:00", "1996-09-17 12:00")]
_DATED = """SELECT day, mgd, CASE WHEN mgd > 0 THEN CASE WHEN day >= DATE '1996-08-27' AND day < TIMESTAMP '1996-10-02 14:30' THEN 0.0
      ELSE 6230.0::DOUBLE * 0.32::DOUBLE END / (mgd * 8.34::DOUBLE) END AS hcl_mgl,
    CASE WHEN mgd > 0 THEN CASE WHEN day >= TIMESTAMP '1996-09-09 08:00' AND day < TIMESTAMP '1996-09-17 12:00' THEN 0.0
      ELSE 583.0::DOUBLE * 0.379::DOUBLE END / (mgd * 8.34::DOUBLE) END AS ferric_mgl
  FROM (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1000000 AS mgd FROM orders GROUP BY 1)"""


def _dated(spark, d):
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        (F.sum("o_totalprice") / 1000000).alias("mgd")
    )
    return daily.withColumns(
        {
            "hcl_mgl": dosing.dated_dose_mgl("day", "mgd", plant.HCL_SOLUTION_LBS, plant.HCL_STRENGTH, _OFF_HCL),
            "ferric_mgl": dosing.dated_dose_mgl("day", "mgd", plant.FERRIC_SOLUTION_LBS, plant.FERRIC_STRENGTH, _OFF_FERRIC),
        }
    )


@add("dated_dose", sql(_DATED, rounded="mgd hcl_mgl ferric_mgl"))
def dated_dose(spark, d):
    return _dated(spark, d)


@add(
    "gas_per_dose",
    sql(f"SELECT day, 1000 / nullif(hcl_mgl, 0) AS hcl_efficiency, 10 / nullif(ferric_mgl, 0) AS ferric_efficiency FROM ({_DATED})",
        rounded="hcl_efficiency ferric_efficiency"),
)
def gas_per_dose(spark, d):
    return _dated(spark, d).select(
        "day",
        dosing.gas_per_dose(F.lit(1000), "hcl_mgl").alias("hcl_efficiency"),
        dosing.gas_per_dose(F.lit(10), "ferric_mgl").alias("ferric_efficiency"),
    )


_CAL = """hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS dayofweek, dayofyear(ts) AS dayofyear, month(ts) AS month,
  CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend,
  sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS hour_sin, cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS hour_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos"""
_CAL_DOUBLES = "hour_sin hour_cos dow_sin dow_cos"


@add("calendar_features", sql(f"SELECT event_id, {_CAL} FROM events", rounded=_CAL_DOUBLES))
def calendar_features(spark, d):
    return features.calendar(table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


_X = {
    "flow_x_hcl": "total_gpm * hcl_available",
    "flow_x_ferric": "total_gpm * ferric_available",
    "load_x_hcl": "lbs_per_min * hcl_available",
    "load_x_ferric": "lbs_per_min * ferric_available",
    "temp_nh3_x_hcl": '"nh3_temperature_°f" * hcl_available',
    "temp_nh3_x_ferric": '"nh3_temperature_°f" * ferric_available',
    "temp_h2s_x_hcl": '"h2s_temperature_°f" * hcl_available',
    "temp_h2s_x_ferric": '"h2s_temperature_°f" * ferric_available',
    "nh3_x_flow": "nh3_roll_mean_15min * total_gpm",
    "h2s_x_flow": "h2s_roll_max_15min * total_gpm",
}


@add(
    "interaction_features",
    sql(f"SELECT ts, {_COMMA(f'{e} AS {n}' for n, e in _X.items())} FROM loaded", "loaded", " ".join(_X)),
)
def interaction_features(spark, d):
    return features.interactions(dosing.loads(site_minutes(spark, d), "ts")).select("ts", *_X)


_GAS = {"nh3": plant.NH3, "h2s": plant.H2S}
_READY = {h: f"{plant.NH3}_t_plus_{h}min IS NOT NULL AND {plant.H2S}_t_plus_{h}min IS NOT NULL" for h in plant.HORIZONS_MIN}
_LEAD = _COMMA(
    f"lead({c}, {h}) OVER o AS {c}_t_plus_{h}min"
    for h in plant.HORIZONS_MIN
    for c in (plant.NH3, plant.H2S, plant.RAW_NH3, plant.RAW_H2S)
)
_QUALITY = (
    "CAST(nh3_roll_mean_15min IS NOT NULL OR h2s_roll_max_15min IS NOT NULL AS BIGINT) AS gas_data_available, "
    "CAST(nh3_roll_mean_15min IS NOT NULL AND h2s_roll_max_15min IS NOT NULL AS BIGINT) AS both_gas_signals_available, "
    "CAST(coalesce(sensor_valid, 0) AS BIGINT) AS sensor_valid_flag, "
    "CAST(total_gpm IS NOT NULL AS BIGINT) AS feature_row_complete, "
) + _COMMA(
    f"CAST({r} AS BIGINT) AS target_ready_{h}min, CAST(coalesce(sensor_valid, 0) = 1 AND {r} AS BIGINT) AS model_row_valid_{h}min"
    for h, r in _READY.items()
)
_DELTAS = _COMMA(
    f"{c}_t_plus_{h}min - {c} AS {g}_delta_{h}min, "
    f'CAST(coalesce({c}_t_plus_{h}min >= {plant.LIMITS[g]}, FALSE) AS BIGINT) AS "{g}_exceeds_{plant.LIMITS[g]}_ppm_t_plus_{h}min"'
    for h in plant.HORIZONS_MIN
    for g, c in _GAS.items()
)
_SINCE = _COMMA(
    f"date_diff('minute', last_value(CASE WHEN {s}_d {test} THEN ts END IGNORE NULLS) OVER r, ts)::DOUBLE AS minutes_since_{s}_{e}"
    for s in ("ferric", "hcl")
    for e, test in (("on", "= 1"), ("off", "= -1"), ("state_change", "IS DISTINCT FROM 0"))
)
_SINCE_NAMES = " ".join(f"minutes_since_{s}_{e}" for s in ("ferric", "hcl") for e in ("on", "off", "state_change"))
_LEAD_NAMES = " ".join(
    f"{c}_t_plus_{h}min" for h in plant.HORIZONS_MIN for c in (plant.NH3, plant.H2S, plant.RAW_NH3, plant.RAW_H2S)
)
_DELTA_NAMES = " ".join(f"{g}_delta_{h}min" for h in plant.HORIZONS_MIN for g in _GAS)
_KEPT = (
    f"{plant.NH3} {plant.H2S} {plant.RAW_NH3} {plant.RAW_H2S} {_LOADS} transferred_lbs_vol {_SINCE_NAMES} {_CAL_DOUBLES} "
    f"{' '.join(_X)} {_LEAD_NAMES} {_DELTA_NAMES}"
)
_SPLIT = """CASE WHEN p < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
  WHEN p < CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split"""
MODELING_SQL = f"""SELECT *, {_DELTAS}, {_QUALITY}, {_SPLIT} FROM (
  SELECT *, lbs_per_min AS transferred_lbs_vol, {_SINCE}, {_CAL}, {_COMMA(f'{e} AS {n}' for n, e in _X.items())}
  FROM (SELECT *, row_number() OVER o - 1 AS p, count(*) OVER () AS n, {_LEAD},
          coalesce(ferric_available, 0) - lag(coalesce(ferric_available, 0)) OVER o AS ferric_d,
          coalesce(hcl_available, 0) - lag(coalesce(hcl_available, 0)) OVER o AS hcl_d
        FROM loaded WINDOW o AS (ORDER BY ts))
  WINDOW r AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_FLAG_NAMES = (
    "gas_data_available both_gas_signals_available sensor_valid_flag feature_row_complete "
    + " ".join(f"target_ready_{h}min model_row_valid_{h}min" for h in plant.HORIZONS_MIN)
)
_CAL_INTS = "hour minute dayofweek dayofyear month is_weekend"
_EXCEEDS = [f"{g}_exceeds_{plant.LIMITS[g]}_ppm_t_plus_{h}min" for h in plant.HORIZONS_MIN for g in _GAS]


@add(
    "modeling_table",
    sql(
        f"""SELECT ts, {_COMMA(_KEPT.split())}, {_COMMA(_CAL_INTS.split())}, {_COMMA(_FLAG_NAMES.split())},
              {_COMMA(f'"{n}"' for n in _EXCEEDS)}, split FROM ({MODELING_SQL})""",
        "loaded",
        _KEPT,
    ),
)
def modeling_table_query(spark, d):
    out = modeling_table(site_minutes(spark, d), "ts")
    return out.select(
        "ts", *_KEPT.split(), *_CAL_INTS.split(), *_FLAG_NAMES.split(), *[F.col(f"`{n}`") for n in _EXCEEDS], "split"
    )


@add("quality_flags", sql(f"SELECT ts, {_COMMA(_FLAG_NAMES.split())} FROM ({MODELING_SQL})", "loaded"))
def quality_flags(spark, d):
    targets = features.future_targets(dosing.loads(site_minutes(spark, d), "ts"), "ts")
    return features.quality_flags(targets).select("ts", *_FLAG_NAMES.split())


@add(
    "modeling_metadata",
    sql(
        f"""SELECT count(*) AS n_rows, CAST(min(ts) AS VARCHAR) AS "start", CAST(max(ts) AS VARCHAR) AS "end",
              count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation,
              count(*) FILTER (split = 'test') AS test,
              {_COMMA(f'CAST(sum(model_row_valid_{h}min) AS BIGINT) AS valid_{h}' for h in plant.HORIZONS_MIN)}
            FROM ({MODELING_SQL})""",
        "loaded",
    ),
)
def modeling_metadata_query(spark, d):
    meta = modeling_metadata(modeling_table(site_minutes(spark, d), "ts"), "ts")
    return meta.select(
        "n_rows", "start", "end", "split_counts.train", "split_counts.validation", "split_counts.test",
        *[F.col(f"valid_rows_by_horizon.h{h}").alias(f"valid_{h}") for h in plant.HORIZONS_MIN],
    )


_PHASES = [("before", "1997-01-01"), ("during", "1999-01-01"), ("after", None)]


@add(
    "phase_labels",
    """SELECT o_orderkey, CASE WHEN o_orderdate < '1997-01-01' THEN 'before' WHEN o_orderdate < '1999-01-01' THEN 'during'
         ELSE 'after' END AS phase, CAST(o_orderdate BETWEEN '1996-08-27' AND TIMESTAMP '1996-10-02 14:30' AS BIGINT) AS hcl_off
       FROM orders""",
)
def phase_labels(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        dosing.phase("o_orderdate", _PHASES).alias("phase"),
        dosing.closed_flag("o_orderdate", "1996-08-27", "1996-10-02 14:30").alias("hcl_off"),
    )
