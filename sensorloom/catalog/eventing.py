"""Transitions, operating flags, event response, event study."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.catalog.base import Catalog, site_events, site_minutes, sql, table
from sensorloom.functions.timekit import working_hours
from sensorloom.operators import dosing, events
from sensorloom.plans.analysis import Analysis
from sensorloom.sources.tables import FrameSet

CATALOG = Catalog()
add = CATALOG.add


@add("state_transitions", sql("SELECT ts, chemical, event_type FROM found", "found"))
def state_transitions(spark, d):
    return site_events(spark, d)


_HOURLY = """SELECT event_type AS k, date_trunc('hour', ts) AS ts, CAST(avg(value) >= 50 AS INT) AS s FROM events GROUP BY 1, 2"""


def _hourly_states(spark, d):
    """Irregular hours per type: hours without an event are absent."""
    ev = table(spark, d, "events")
    return ev.groupBy(F.col("event_type").alias("k"), F.date_trunc("hour", "ts").alias("ts")).agg(
        (F.avg("value") >= 50).cast("int").alias("busy")
    )


@add(
    "hourly_transitions_by_key",
    f"""SELECT k, ts, 'Busy' AS chemical, CASE WHEN g = 1 THEN 'ON' ELSE 'OFF' END AS event_type FROM (
          SELECT k, ts, s - lag(s) OVER (PARTITION BY k ORDER BY ts) AS g FROM ({_HOURLY})) WHERE g IN (1, -1)""",
)
def hourly_transitions_by_key(spark, d):
    return events.transitions(_hourly_states(spark, d), "ts", {"Busy": "busy"}, keys=["k"])


@add(
    "transitions_with_first_row",
    f"""SELECT k, ts, 'Busy' AS chemical, CASE WHEN s = 1 THEN 'ON' ELSE 'OFF' END AS event_type FROM (
          SELECT k, ts, s, lag(s) OVER (PARTITION BY k ORDER BY ts) AS p FROM ({_HOURLY})) WHERE p IS NULL OR p != s""",
)
def transitions_with_first_row(spark, d):
    return events.transitions(
        _hourly_states(spark, d), "ts", {"Busy": "busy"}, keys=["k"], include_first=True, missing_is_off=False
    )


@add("event_counts", sql("SELECT chemical, event_type, count(*) AS n FROM found GROUP BY 1, 2", "found"))
def event_counts(spark, d):
    return events.event_counts(site_events(spark, d))


@add(
    "first_transitions",
    sql(
        """SELECT chemical, event_type, min(ts) AS first_ts, chemical || ' ' || event_type AS label FROM found GROUP BY 1, 2""",
        "found",
    ),
)
def first_transitions(spark, d):
    return events.first_transitions(site_events(spark, d), "ts")


# dated windows inside the order record, in the form of the plant calendar
_CALENDAR = {
    "hcl_available": (1, [("1996-08-27 00:00", "1996-10-02 14:30", 0), ("1999-11-06 00:00", None, 0)]),
    "ferric_available": (1, [("1996-09-09 08:00", "1996-09-17 12:00", 0)]),
    "sensor_valid": (1, [("2000-10-08 08:00", None, 0)]),
    "ferric_reduced_rate": (0, [("2001-01-07 00:00", None, 1)]),
}


@add(
    "operating_flags",
    """SELECT o_orderkey,
         CAST(NOT (o_orderdate >= '1996-08-27' AND o_orderdate < TIMESTAMP '1996-10-02 14:30' OR o_orderdate >= '1999-11-06')
           AS BIGINT) AS hcl_available,
         CAST(NOT (o_orderdate >= TIMESTAMP '1996-09-09 08:00' AND o_orderdate < TIMESTAMP '1996-09-17 12:00') AS BIGINT)
           AS ferric_available,
         CAST(o_orderdate < TIMESTAMP '2000-10-08 08:00' AS BIGINT) AS sensor_valid,
         CAST(o_orderdate >= '2001-01-07' AS BIGINT) AS ferric_reduced_rate,
         CAST(0 AS BIGINT) AS truck_activity_proxy FROM orders""",
)
def operating_flags(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return dosing.operating_flags(o, "o_orderdate", _CALENDAR).drop("o_orderdate")


@add(
    "working_hours_proxy",
    """SELECT event_id, CAST(isodow(ts) <= 5 AND hour(ts) BETWEEN 7 AND 18 AS BIGINT) AS truck_activity_proxy FROM events""",
)
def working_hours_proxy(spark, d):
    return table(spark, d, "events").select("event_id", working_hours("ts").alias("truck_activity_proxy"))


@add("event_aligned_signal", sql("SELECT * FROM aligned", "aligned", "value"))
def event_aligned_signal(spark, d):
    site = site_minutes(spark, d)
    return events.aligned_signal(site, "ts", events.transitions(site, "ts"), plant.NH3)


@add(
    "event_relative_slice",
    sql(
        """SELECT chemical, event_type, event_ts, rel_min, value FROM aligned
           WHERE value IS NOT NULL AND rel_min BETWEEN -1440 AND -60""",
        "aligned",
        "value",
    ),
)
def event_relative_slice(spark, d):
    site = site_minutes(spark, d)
    rel = events.aligned_signal(site, "ts", events.transitions(site, "ts"), plant.NH3, drop_missing=True)
    return events.rel_between(rel, plant.PRETREND_WINDOW)


_METRICS = " ".join(events.METRICS)


@add(
    "event_response_single",
    sql(
        f"SELECT chemical, event_type, event_ts, signal, {', '.join(events.METRICS)} FROM single",
        "single",
        _METRICS.replace("time_to_min", "").replace("persistence", ""),
    ),
)
def event_response_single(spark, d):
    site = site_minutes(spark, d)
    return events.per_event_metrics(site, "ts", events.transitions(site, "ts"))


@add("event_response_median", sql("SELECT * FROM metrics", "metrics", _METRICS))
def event_response_median(spark, d):
    return events.metrics_table(site_minutes(spark, d), "ts")


@add(
    "unexpected_directions",
    sql(
        """SELECT chemical, event_type, signal, delta,
             CASE WHEN chemical = 'Ferric' AND event_type = 'OFF' AND delta < 0 THEN 'decrease after OFF'
                  WHEN chemical = 'Ferric' AND event_type = 'ON' AND delta > 0 THEN 'increase after ON'
                  WHEN chemical = 'HCl' AND event_type = 'ON' AND signal = 'NH3' AND delta > 0 THEN 'increase after ON'
             END AS warning FROM metrics""",
        "metrics",
        "delta",
    ),
)
def unexpected_directions(spark, d):
    out = events.flag_unexpected(events.metrics_table(site_minutes(spark, d), "ts"))
    return out.select("chemical", "event_type", "signal", "delta", "warning")


@add(
    "strongest_effects",
    sql(
        """SELECT chemical, event_type, signal, percent_change FROM metrics
           ORDER BY abs(percent_change) DESC NULLS LAST, chemical, event_type, signal LIMIT 3""",
        "metrics",
        "percent_change",
    ),
)
def strongest_effects(spark, d):
    top = events.strongest_effects(events.metrics_table(site_minutes(spark, d), "ts"))
    return top.select("chemical", "event_type", "signal", "percent_change")


def _study(spark, d):
    return events.study_summary(event_aligned_signal(spark, d))


@add("event_study_summary", sql("SELECT * FROM study", "study", "median q25 q75"))
def event_study_summary(spark, d):
    return _study(spark, d)


@add(
    "pretrend_check",
    sql(
        """SELECT chemical, event_type, max(median) FILTER (w) - min(median) FILTER (w) AS pre_variation,
             CASE WHEN count(*) FILTER (w) = 0 THEN TRUE
                  ELSE coalesce(max(median) FILTER (w) - min(median) FILTER (w) <= 0.1, FALSE) END AS stable
           FROM (SELECT *, rel_min BETWEEN -1440 AND -60 AS w FROM study) GROUP BY 1, 2""",
        "study",
        "pre_variation",
    ),
)
def pretrend_check(spark, d):
    return events.pretrend_check(_study(spark, d))


_CLIP = "BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-21 23:59'"


@add(
    "filtered_window_metrics",
    sql("SELECT * FROM metrics", "metrics", _METRICS).replace(
        "states AS (SELECT ts, 'Ferric' AS chemical",
        f"whole AS (SELECT * FROM site WHERE ts {_CLIP}),\nstates AS (SELECT ts, 'Ferric' AS chemical",
    )
    .replace("ferric_available, 0) AS s FROM site", "ferric_available, 0) AS s FROM whole")
    .replace("hcl_available, 0) FROM site", "hcl_available, 0) FROM whole")
    .replace("nh3_roll_mean_15min AS value FROM site", "nh3_roll_mean_15min AS value FROM whole")
    .replace("h2s_roll_max_15min FROM site", "h2s_roll_max_15min FROM whole"),
)
def filtered_window_metrics(spark, d):
    whole = Analysis(FrameSet(minute=site_minutes(spark, d)))
    return whole.between("2024-01-08 00:00", "2024-01-21 23:59").event_metrics()


@add("filtered_window_events", sql(f"SELECT ts, chemical, event_type FROM found WHERE ts {_CLIP}", "found"))
def filtered_window_events(spark, d):
    whole = Analysis(FrameSet(minute=site_minutes(spark, d)))
    return whole.between("2024-01-08 00:00", "2024-01-21 23:59").events()
