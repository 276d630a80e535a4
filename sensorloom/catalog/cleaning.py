"""Names, coercion, time parsing, deduplication, time selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalog.base import Catalog, site_minutes, sql, table
from sensorloom.functions import names as nm
from sensorloom.functions.numeric import unit_interval
from sensorloom.functions.timekit import from_local, local_date, parse_time, shift_minutes, to_local
from sensorloom.operators import clean

CATALOG = Catalog()
add = CATALOG.add


@add(
    "column_name_cleanup",
    """SELECT o_orderkey AS plant_order_key, o_totalprice AS east_sludge_out_gpm, o_orderstatus AS plant_status_code
       FROM orders""",
)
def column_name_cleanup(spark, d):
    o = table(spark, d, "orders")
    raw = o.toDF(" Order (Key)", "Unnamed: 1", "Status Code", "Eest Sludge Out GPM", "x ISO Time", "Status  Code ")
    raw = raw.select(*[nm.col(c) for c in raw.columns[:4]], nm.col("Status Code"), nm.col("x ISO Time"))
    # a repeated name keeps its first column
    out = nm.drop_export_junk(nm.first_of_each_name(nm.tidy_names(raw)))
    out = nm.fix_spelling(out, {"eest_sludge_out_gpm": "east_sludge_out_gpm"})
    out = nm.add_prefix(out, "plant_", keep=["east_sludge_out_gpm"])
    return nm.keep_renamed(
        out,
        {
            "plant_order_key": "plant_order_key",
            "east_sludge_out_gpm": "east_sludge_out_gpm",
            "plant_status_code": "plant_status_code",
            "plant_absent": "absent",
        },
    )


@add(
    "mixed_time_formats",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN date_trunc('second', ts) END AS ts,
         CASE WHEN event_type = 'view' THEN date_trunc('second', ts) END AS plant_ts FROM events""",
)
def mixed_time_formats(spark, d):
    ev, kind = table(spark, d, "events"), F.col("event_type")
    text = (
        F.when(kind == "view", F.date_format("ts", "M/d/yy h:mm:ss a"))
        .when(kind == "click", F.concat(F.lit("  "), F.date_format("ts", "M-d-yyyy, h-mm-ss a")))
        .when(kind == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "error", "13/45/24 99:00:00 AM")
    )
    return ev.withColumn("text", text).select(
        "event_id", parse_time("text").alias("ts"), parse_time("text", ["M/d/yy h:mm:ss a"], general=False).alias("plant_ts")
    )


@add(
    "numeric_coercion",
    sql(
        """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS level,
             CAST(coalesce(CASE WHEN event_type IN ('view', 'click') THEN value > 50 END, FALSE) AS BIGINT) AS unit_available,
             least(greatest(coalesce(CASE WHEN event_type != 'signup' THEN value / 100 END, 0.0), 0.0), 1.0) AS share
           FROM events""",
        rounded="level share",
    ),
)
def numeric_coercion(spark, d):
    ev, kind, v = table(spark, d, "events"), F.col("event_type"), F.col("value")
    text = ev.select(
        "event_id",
        F.when(kind == "error", "No Data").otherwise(v.cast("string")).alias("level"),
        F.when(kind.isin("view", "click"), (v > 50).cast("int").cast("string")).otherwise("?").alias("unit_available"),
        F.when(kind != "signup", v / 100).alias("share"),
    )
    binary = nm.binary_names(text.columns, "_available", ["sensor_valid"])
    out = clean.coerce(text, ["level"], binary)
    return out.withColumn("share", unit_interval("share"))


@add(
    "local_time_shift",
    """SELECT event_id, ts - INTERVAL 5 HOURS AS local_ts, CAST(ts - INTERVAL 5 HOURS AS DATE) AS local_date,
         ts + INTERVAL 5 HOURS AS from_local_ts FROM events""",
)
def local_time_shift(spark, d):
    # the record lies in one winter, so the zone is five hours behind throughout
    return table(spark, d, "events").select(
        "event_id", to_local("ts").alias("local_ts"), local_date("ts").alias("local_date"), from_local("ts").alias("from_local_ts")
    )


# clocks went forward on the first Sunday of April, 7:00 UTC, and back on the last Sunday of October, 6:00 UTC
_CLOCKS = """placed AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey * 7 % 1440 AS BIGINT)) AS ts FROM orders),
sundays AS (SELECT *, make_timestamp(year(ts), 4, 1, 7, 0, 0) + to_days(CAST((7 - dayofweek(make_date(year(ts), 4, 1))) % 7 AS INT)) AS spring,
    make_timestamp(year(ts), 10, 31, 6, 0, 0) - to_days(CAST(dayofweek(make_date(year(ts), 10, 31)) AS INT)) AS fall FROM placed),
local_ AS (SELECT o_orderkey, ts, ts - to_hours(CASE WHEN ts >= spring AND ts < fall THEN 4 ELSE 5 END) AS local_ts FROM sundays)"""


@add(
    "local_time_over_clock_changes",
    f"""WITH {_CLOCKS} SELECT o_orderkey, ts, local_ts, CAST(local_ts AS DATE) AS local_date FROM local_""",
)
def local_time_over_clock_changes(spark, d):
    """Wall-clock times and dates of instants in winter and in summer time, some within an hour of the change."""
    minute = F.col("o_orderkey") * 7 % 1440
    placed = table(spark, d, "orders").select("o_orderkey", shift_minutes("o_orderdate", minute).alias("ts"))
    return placed.select("o_orderkey", "ts", to_local("ts").alias("local_ts"), local_date("ts").alias("local_date"))


@add("time_column_choice", "SELECT o_orderkey, o_orderdate AS ts FROM orders")
def time_column_choice(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("ISO time"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Datetime")
    )
    return clean.pick_time_column(o, ["ISO time", "Absent", "Datetime"], "ts").select("o_orderkey", "ts")


@add(
    "first_row_per_minute",
    sql(
        """SELECT ts, event_id, event_type, value FROM (
             SELECT date_trunc('minute', ts) AS ts, event_id, event_type, value,
               row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY event_id) AS r FROM events)
           WHERE r = 1""",
        rounded="value",
    ),
)
def first_row_per_minute(spark, d):
    ev = table(spark, d, "events").select(F.date_trunc("minute", "ts").alias("ts"), "event_id", "event_type", "value")
    return clean.first_per_time(ev, "ts", ["event_id"])


@add(
    "unusable_rows_dropped",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority != '5-LOW'",
)
def unusable_rows_dropped(spark, d):
    o = table(spark, d, "orders")
    flawed = o.select(
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("o_orderkey"),
        F.when(F.col("o_orderstatus") != "F", F.when(F.col("o_orderpriority") == "5-LOW", "o_orderstatus").otherwise(
            F.when(F.col("o_orderstatus") == "O", F.col("o_orderstatus"))
        )).alias("o_orderstatus"),
    )
    return clean.drop_unusable(flawed, required=["o_orderstatus"], label="o_orderstatus")


@add(
    "first_filled_column",
    sql(
        """SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN value END,
             CASE WHEN value > 50 THEN value * 2 END) AS combined FROM events""",
        rounded="combined",
    ),
)
def first_filled_column(spark, d):
    ev = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", F.col("value")).alias("a"),
        F.when(F.col("value") > 50, F.col("value") * 2).alias("b"),
    )
    return clean.first_filled(ev, "combined", ["a", "absent", "b"]).select("event_id", "combined")


@add(
    "column_availability",
    sql(
        """SELECT u.name AS "column", u.n AS n_values, c.n_rows, u.n > 0 AS has_data FROM (
             SELECT 'nh3_roll_mean_15min' AS name, count(nh3_roll_mean_15min) AS n FROM site
             UNION ALL SELECT 'h2s_roll_max_15min', count(h2s_roll_max_15min) FROM site
             UNION ALL SELECT 'absent_signal', 0) u, (SELECT count(*) AS n_rows FROM site) c""",
        "site",
    ),
)
def column_availability(spark, d):
    minutes = site_minutes(spark, d).withColumn("absent_signal", F.lit(None).cast("double"))
    wanted = nm.present(minutes, ["nh3_roll_mean_15min", "h2s_roll_max_15min", "absent_signal", "not_a_column"])
    return clean.availability(minutes, wanted)


@add(
    "days_available",
    sql(
        """SELECT u.name AS "column", u.n AS n_values, c.n_rows, u.n > 0 AS has_data FROM (
             SELECT 'o_orderdate' AS name, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders
             UNION ALL SELECT 'urgent', count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders
               WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000) u,
             (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS n_rows FROM orders) c"""
    ),
)
def days_available(spark, d):
    o = table(spark, d, "orders")
    dear = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)
    daily = o.groupBy(F.to_date("o_orderdate").alias("o_orderdate")).agg(F.avg(F.when(dear, F.col("o_totalprice"))).alias("urgent"))
    return clean.availability(daily)


_DAYS = {"full": "lo", "last30": "greatest(lo, hi - 29)", "last60": "greatest(lo, hi - 59)"}


@add(
    "window_choice",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS mode, CAST({e} AS TIMESTAMP) AS start_ts, CAST(hi AS TIMESTAMP) + INTERVAL 1439 MINUTE AS end_ts
            FROM (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders)"""
        for m, e in _DAYS.items()
    )
    + """ UNION ALL SELECT 'custom', TIMESTAMP '1996-02-01', TIMESTAMP '1996-03-01 23:59' FROM orders HAVING count(*) > 0""".replace(
        "FROM orders HAVING count(*) > 0", "WHERE EXISTS (SELECT 1 FROM orders)"
    ),
)
def window_choice(spark, d):
    o = table(spark, d, "orders")
    out = None
    for mode, span in (("full", ()), ("last30", ()), ("last60", ()), ("custom", ("1996-03-01", "1996-02-01"))):
        one = clean.window_bounds(o, "o_orderdate", mode, *span).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@add(
    "last_30_days",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT CAST(max(o_orderdate) AS DATE) - 29 FROM orders)""",
)
def last_30_days(spark, d):
    o = table(spark, d, "orders")
    return clean.clip_to_window(o, "o_orderdate", clean.window_bounds(o, "o_orderdate", "last30")).select("o_orderkey", "o_orderdate")


@add(
    "low_flow_split",
    sql(
        """SELECT part, count(*) AS n, avg(value) AS mean FROM (
             SELECT CASE WHEN value / 1000 <= 0.05 THEN 'low' ELSE 'kept' END AS part, value FROM events) GROUP BY 1""",
        rounded="mean",
    ),
)
def low_flow_split(spark, d):
    low, kept = clean.split_by(table(spark, d, "events"), F.col("value") / 1000 <= 0.05)
    tagged = low.withColumn("part", F.lit("low")).unionByName(kept.withColumn("part", F.lit("kept")))
    return tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


