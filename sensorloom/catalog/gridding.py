"""Minute bins, grids, gap filling, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.catalog.base import Catalog, filled_grid, signal_grid, signal_log, site_minutes, sql, table
from sensorloom.operators import dosing, rollup
from sensorloom.operators.grid import filled_minutes

CATALOG = Catalog()
add = CATALOG.add


@add("minute_grid", sql("SELECT k, ts, v, CAST(v IS NULL AS BIGINT) AS interp_flag FROM grid", "grid", "v"))
def minute_grid_query(spark, d):
    return filled_minutes(signal_log(spark, d), "ts", means=["v"], keys=["k"], flag="interp_flag")


@add("gap_fill", sql("SELECT k, ts, v FROM filled", "filled", "v"))
def gap_fill(spark, d):
    return filled_grid(spark, d)


@add(
    "forward_fill",
    sql(
        """SELECT k, ts, coalesce(last_value(v IGNORE NULLS) OVER (
             PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS v FROM grid""",
        "grid",
        "v",
    ),
)
def forward_fill_query(spark, d):
    return filled_minutes(signal_log(spark, d), "ts", means=["v"], keys=["k"], carried={"v": 0.0})


@add(
    "hour_ending_rollup",
    sql(
        """SELECT g.k, g.ts, coalesce(total, 0.0) AS total, mean, peak
           FROM (SELECT k, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS ts FROM ended GROUP BY k) g
           LEFT JOIN (SELECT k, h, sum(value) AS total, avg(value) AS mean, max(value) AS peak
                      FROM ended GROUP BY 1, 2) r ON r.k = g.k AND r.h = g.ts""",
        rounded="total mean peak",
    ).replace(
        "FROM ended",
        """FROM (SELECT event_type AS k, value, CASE WHEN ts = date_trunc('hour', ts) THEN ts
             ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS h FROM events)""",
    ),
)
def hour_ending_rollup(spark, d):
    ev = table(spark, d, "events").withColumnRenamed("event_type", "k")
    return rollup.hour_ending(
        ev, "ts", sums={"total": "value"}, means={"mean": "value"}, maxima={"peak": "value"}, keys=["k"]
    )


@add(
    "plant_hourly",
    sql(
        """SELECT h AS ts, coalesce(sum(total_gpm), 0.0) AS flow_gal_hr, coalesce(sum(lbs_per_min), 0.0) AS lbs_volatile,
             coalesce(sum(lbs_per_min), 0.0) / 24.3::DOUBLE AS fecl3_lbs,
             max(h2s_roll_max_15min) AS h2s_roll_max_15min, avg(nh3_roll_mean_15min) AS nh3_roll_mean_15min,
             avg("nh3_temperature_°f") AS "nh3_temperature_°f", avg("h2s_temperature_°f") AS "h2s_temperature_°f"
           FROM (SELECT *, CASE WHEN ts = date_trunc('hour', ts) THEN ts
                   ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS h FROM loaded) GROUP BY 1""",
        "loaded",
        'flow_gal_hr lbs_volatile fecl3_lbs h2s_roll_max_15min nh3_roll_mean_15min "nh3_temperature_°f" "h2s_temperature_°f"',
    ),
)
def plant_hourly(spark, d):
    return rollup.plant_hourly(dosing.loads(site_minutes(spark, d), "ts"), "ts")


@add(
    "hour_starting_rollup",
    sql(
        """SELECT k, date_trunc('hour', ts) AS ts, avg(v) AS mean, max(v) AS peak FROM grid
           GROUP BY 1, 2 HAVING count(v) > 0""",
        "grid",
        "mean peak",
    ),
)
def hour_starting_rollup(spark, d):
    grid = signal_grid(spark, d).select("k", "ts", F.col("v").alias("mean"), F.col("v").alias("peak"))
    return rollup.hour_starting(grid, "ts", means=["mean"], maxima=["peak"], keys=["k"])


@add(
    "positive_hourly_load",
    sql(
        """SELECT h AS ts, sum(lbs_per_min) AS lbs_volatile
           FROM (SELECT *, CASE WHEN ts = date_trunc('hour', ts) THEN ts
                   ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS h FROM loaded)
           GROUP BY 1 HAVING sum(lbs_per_min) > 0""",
        "loaded",
        "lbs_volatile",
    ),
)
def positive_hourly_load(spark, d):
    minutes = dosing.loads(site_minutes(spark, d), "ts")
    return rollup.hour_ending(minutes, "ts", sums={"lbs_volatile": "lbs_per_min"}).where("lbs_volatile > 0")


_DAILY = """nh3_roll_mean_15min h2s_roll_max_15min east_sludge_out_gpm west_sludge_out_gpm
 digesters_sludge_out_flow h2s_std nh3_std total_gpm transferred_lbs_vol_daily nh3_coverage h2s_coverage water_coverage"""


@add(
    "daily_rollup",
    sql(
        "SELECT * REPLACE (CAST(ferric_available AS BIGINT) AS ferric_available, "
        "CAST(hcl_available AS BIGINT) AS hcl_available) FROM site_daily",
        "site_daily",
        _DAILY,
    ),
)
def daily_rollup(spark, d):
    return rollup.plant_daily(site_minutes(spark, d), "ts")


_MEANS = ", ".join(
    f"avg({c}) AS {n}"
    for c, n in [
        ("nh3_roll_mean_15min", "nh3_{p}_mean"),
        ("h2s_roll_max_15min", "h2s_{p}_mean"),
        ("total_gpm", "total_gpm_{p}_mean"),
        ("transferred_lbs_vol_daily", "transferred_lbs_vol_{p}_mean"),
        ("ferric_available", "ferric_available"),
        ("hcl_available", "hcl_available"),
        ("nh3_std", "nh3_std"),
        ("n_obs_nh3", "n_obs_nh3"),
        ("water_coverage", "water_coverage"),
    ]
)
_MEAN_NAMES = (
    "nh3_{p}_mean h2s_{p}_mean total_gpm_{p}_mean transferred_lbs_vol_{p}_mean ferric_available hcl_available "
    "nh3_std n_obs_nh3 water_coverage"
)
_MEAN_COLUMNS = [
    plant.NH3,
    plant.H2S,
    "total_gpm",
    "transferred_lbs_vol_daily",
    "ferric_available",
    "hcl_available",
    "nh3_std",
    "n_obs_nh3",
    "water_coverage",
]


@add(
    "plant_month_summary",
    sql(
        f"SELECT month(day) AS month, {_MEANS.format(p='monthly')}, count(*) AS days_in_data FROM site_daily GROUP BY 1",
        "site_daily",
        _MEAN_NAMES.format(p="monthly"),
    ),
)
def plant_month_summary(spark, d):
    return rollup.month_summary(rollup.plant_daily(site_minutes(spark, d), "ts"), columns=_MEAN_COLUMNS)


@add(
    "plant_weekday_summary",
    sql(
        f"""SELECT isodow(day) - 1 AS weekday, {_MEANS.format(p='weekday')}, count(*) AS days_in_data,
              any_value(dayname(day)) AS weekday_name FROM site_daily GROUP BY 1""",
        "site_daily",
        _MEAN_NAMES.format(p="weekday"),
    ),
)
def plant_weekday_summary(spark, d):
    return rollup.weekday_summary(rollup.plant_daily(site_minutes(spark, d), "ts"), columns=_MEAN_COLUMNS)


_ORDERS = "SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1"


def _order_days(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("price"))


@add(
    "month_summary_across_years",
    sql(
        f"""SELECT m AS month, left(monthname(make_date(2000, m, 1)), 3) AS label, price, n AS days_in_data FROM (
             SELECT month(day) AS m, avg(price) AS price, count(*) AS n FROM ({_ORDERS}) GROUP BY 1)""",
        rounded="price",
    ),
)
def month_summary_across_years(spark, d):
    out = rollup.month_summary(_order_days(spark, d))
    return out.withColumn("label", rollup.month_label("month"))


@add(
    "weekday_summary_across_years",
    sql(
        f"""SELECT isodow(day) - 1 AS weekday, avg(price) AS price, count(*) AS days_in_data,
              any_value(dayname(day)) AS weekday_name FROM ({_ORDERS}) GROUP BY 1""",
        rounded="price",
    ),
)
def weekday_summary_across_years(spark, d):
    return rollup.weekday_summary(_order_days(spark, d))


@add(
    "hourly_gas_mean",
    sql(
        "SELECT date_trunc('hour', ts) AS ts, event_type AS gas, avg(value) AS ppm FROM events GROUP BY 1, 2",
        rounded="ppm",
    ),
)
def hourly_gas_mean(spark, d):
    ev = table(spark, d, "events").select("ts", F.col("event_type").alias("gas"), F.col("value").alias("ppm"))
    return rollup.hour_starting(ev, "ts", means=["ppm"], keys=["gas"])


@add(
    "hourly_peak_flow",
    sql(
        """SELECT date_trunc('hour', ts) AS ts, max(f) AS flow_gal, max(f) / 1000000.0::DOUBLE AS flow_mgd FROM (
             SELECT ts, coalesce(CASE WHEN event_type = 'click' THEN value * 1000 END, 0.0)
               + coalesce(CASE WHEN event_type = 'purchase' THEN value * 1000 END, 0.0) AS f FROM events)
           GROUP BY 1""",
        rounded="flow_gal flow_mgd",
    ),
)
def hourly_peak_flow(spark, d):
    ev = table(spark, d, "events")
    for name, kind in (("west", "click"), ("east", "purchase")):
        ev = ev.withColumn(name, F.when(F.col("event_type") == kind, F.col("value") * 1000))
    return rollup.hourly_peak_flow(ev, "ts", ["west", "east"])


@add(
    "local_daily_tables",
    sql(
        """SELECT CAST(ts - INTERVAL 5 HOURS AS DATE) AS local_date, event_type AS k, avg(value) AS mean, max(value) AS peak
           FROM events GROUP BY 1, 2""",
        rounded="mean peak",
    ),
)
def local_daily_tables(spark, d):
    ev = table(spark, d, "events").select(
        "ts", F.col("event_type").alias("k"), F.col("value").alias("mean"), F.col("value").alias("peak")
    )
    return rollup.local_daily(ev, "ts", means=["mean"], maxima=["peak"], keys=["k"])


@add(
    "daily_means",
    sql(
        """SELECT CAST(o_orderdate AS DATE) AS day, avg(o_orderkey) AS o_orderkey, avg(o_custkey) AS o_custkey,
             avg(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""",
        rounded="o_orderkey o_custkey o_totalprice",
    ),
)
def daily_means(spark, d):
    return rollup.daily_means(table(spark, d, "orders"), "o_orderdate")
