"""Lags, rolling windows, z-scores, targets, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.catalog.base import Catalog, filled_grid, signal_grid, site_minutes, sql, table
from sensorloom.operators import features
from sensorloom.operators.quantiles import exact_quantiles
from sensorloom.operators.windows import chronological_split, row_position

CATALOG = Catalog()
add = CATALOG.add

_LAGS = ", ".join(f"lag(v, {n}) OVER o AS s_lag_{n}min" for n in plant.LAGS_MIN)
_ROLLS = ", ".join(
    f"avg(v) OVER (o ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS s_roll_mean_{n}min, "
    f"max(v) OVER (o ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS s_roll_max_{n}min"
    for n in plant.ROLLS_MIN
)
_LR_NAMES = " ".join(
    [f"s_lag_{n}min" for n in plant.LAGS_MIN]
    + [f"s_roll_{f}_{n}min" for n in plant.ROLLS_MIN for f in ("mean", "max")]
)


@add(
    "lag_and_rolling_features",
    sql(
        f"""SELECT * EXCLUDE (lo) FROM (
              SELECT k, ts, v, min(ts) OVER (PARTITION BY k) AS lo, {_LAGS}, {_ROLLS}
              FROM filled WINDOW o AS (PARTITION BY k ORDER BY ts))
            WHERE ts >= lo + INTERVAL 60 MINUTE""",
        "filled",
        "v " + _LR_NAMES,
    ),
)
def lag_and_rolling_features(spark, d):
    grid = filled_grid(spark, d)
    return features.drop_warmup(features.lag_and_roll(grid, "ts", {"s": "v"}, keys=["k"]), "ts", keys=["k"])


_TARGETS = ", ".join(
    f"""t{h} AS v_t_plus_{h}min, t{h} - v AS v_delta_{h}min,
        CAST(coalesce(t{h} >= 60, FALSE) AS BIGINT) AS "v_exceeds_60.0_ppm_t_plus_{h}min" """
    for h in plant.HORIZONS_MIN
)


@add(
    "future_targets",
    sql(
        f"""SELECT k, ts, v, {_TARGETS} FROM (SELECT *, {", ".join(f"lead(v, {h}) OVER o AS t{h}" for h in plant.HORIZONS_MIN)}
            FROM filled WINDOW o AS (PARTITION BY k ORDER BY ts))""",
        "filled",
        "v " + " ".join(f"v_t_plus_{h}min v_delta_{h}min" for h in plant.HORIZONS_MIN),
    ),
)
def future_targets(spark, d):
    return features.future_targets(filled_grid(spark, d), "ts", gases={"v": "v"}, raw=[], limits={"v": 60.0}, keys=["k"])


_SINCE = ", ".join(
    f"""date_diff('minute', last_value(CASE WHEN {s}_d = 1 THEN ts END IGNORE NULLS) OVER o, ts)::DOUBLE AS minutes_since_{s}_on,
        date_diff('minute', last_value(CASE WHEN {s}_d = -1 THEN ts END IGNORE NULLS) OVER o, ts)::DOUBLE AS minutes_since_{s}_off,
        date_diff('minute', last_value(CASE WHEN {s}_d IS NULL OR {s}_d != 0 THEN ts END IGNORE NULLS) OVER o, ts)::DOUBLE
          AS minutes_since_{s}_state_change"""
    for s in ("ferric", "hcl")
)


@add(
    "minutes_since_changes",
    sql(
        f"""SELECT ts, {_SINCE} FROM (
              SELECT ts, coalesce(ferric_available, 0) - lag(coalesce(ferric_available, 0)) OVER (ORDER BY ts) AS ferric_d,
                coalesce(hcl_available, 0) - lag(coalesce(hcl_available, 0)) OVER (ORDER BY ts) AS hcl_d FROM site)
            WINDOW o AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "site",
        " ".join(f"minutes_since_{s}_{e}" for s in ("ferric", "hcl") for e in ("on", "off", "state_change")),
    ),
)
def minutes_since_changes(spark, d):
    states = site_minutes(spark, d).select("ts", "ferric_available", "hcl_available")
    return features.minutes_since_changes(states, "ts").drop("ferric_available", "hcl_available")


_Z = """SELECT k, ts, v, CASE WHEN n >= 144 AND sd > 0 THEN (v - mean) / sd END AS z_score FROM (
  SELECT k, ts, v, count(v) OVER o AS n, avg(v) OVER o AS mean, stddev_samp(v) OVER o AS sd FROM filled
  WINDOW o AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW))"""


@add("rolling_z_scores", sql(_Z, "filled", "v z_score"))
def rolling_z_scores(spark, d):
    return features.zscore(filled_grid(spark, d), "ts", "v", 1440, keys=["k"])


@add("anomalies", sql(f"SELECT * FROM ({_Z}) WHERE abs(z_score) >= 3", "filled", "v z_score"))
def anomalies(spark, d):
    return features.anomalies(filled_grid(spark, d), "ts", "v", keys=["k"])


@add(
    "top_anomalies",
    sql(f"SELECT * FROM ({_Z}) WHERE abs(z_score) >= 3 ORDER BY abs(z_score) DESC, ts, k LIMIT 500", "filled", "v z_score"),
)
def top_anomalies(spark, d):
    return features.by_severity(features.anomalies(filled_grid(spark, d), "ts", "v", keys=["k"]), "ts", ties=["k"]).limit(500)


_CUT = """CASE WHEN p < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
  WHEN p < CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END"""


@add(
    "chronological_split",
    sql(
        f"""SELECT k, ts, {_CUT} AS split FROM (
             SELECT k, ts, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY k) AS n
             FROM grid)""",
        "grid",
    ),
)
def chronological_split_query(spark, d):
    grid = signal_grid(spark, d)
    return chronological_split(
        grid.select("k", "ts"), "ts", keys=["k"], train=plant.TRAIN_SHARE, validation=plant.VALIDATION_SHARE
    )


@add(
    "row_positions",
    """SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS position, count(*) OVER () AS total FROM events""",
)
def row_positions(spark, d):
    # an irregular log: hour buckets keep the parts small
    return row_position(table(spark, d, "events").select("event_id", "ts"), "ts", span=60).drop("ts")


@add(
    "three_day_smoothing",
    sql(
        """SELECT k, day, v, avg(v) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v_smooth
           FROM (SELECT event_type AS k, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2)""",
        rounded="v v_smooth",
    ),
)
def three_day_smoothing(spark, d):
    ev = table(spark, d, "events")
    daily = ev.groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return features.rolling_by_rows(daily, "day", ["v"], 3, keys=["k"])


@add(
    "first_to_last_change",
    sql(
        """SELECT user_id, CASE WHEN count(value) >= 2 THEN arg_max(value, ts) - arg_min(value, ts) END AS delta
           FROM events GROUP BY 1""",
        rounded="delta",
    ),
)
def first_to_last_change(spark, d):
    ev = table(spark, d, "events")
    return ev.groupBy("user_id").agg(features.first_to_last_change("value", "ts").alias("delta"))


@add(
    "first_exceedance",
    """SELECT k, ts AS start_ts, ts + INTERVAL 2 DAYS AS end_ts FROM (
         SELECT event_type AS k, min(ts) FILTER (
           value > (SELECT quantile_cont(value, 0.99::DOUBLE) FROM events)) AS ts FROM events GROUP BY 1)""",
)
def first_exceedance(spark, d):
    ev = table(spark, d, "events").select(F.col("event_type").alias("k"), "ts", "value")
    limit = exact_quantiles(ev, "value", [0.99], names=["limit"], stored=True)
    bounded = ev.crossJoin(F.broadcast(limit))  # one row
    return features.first_exceedance(bounded, "ts", "value", F.col("limit"), keys=["k"])
