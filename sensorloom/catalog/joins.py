"""Merges, as-of and range joins, wide and long forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalog.base import Catalog, site_minutes, sql, table
from sensorloom.operators import dosing, events, joins, rollup

CATALOG = Catalog()
add = CATALOG.add


def _one_kind(spark, d, kind, name):
    ev = table(spark, d, "events").where(F.col("event_type") == kind)
    return ev.groupBy(F.date_trunc("minute", "ts").alias("ts")).agg(F.avg("value").alias(name))


def _kind_sql(kind, name):
    return f"(SELECT date_trunc('minute', ts) AS ts, avg(value) AS {name} FROM events WHERE event_type = '{kind}' GROUP BY 1)"


@add(
    "outer_merge_series",
    sql(
        f"""SELECT coalesce(a.ts, b.ts, c.ts) AS ts, h2s, nh3, flow FROM {_kind_sql('error', 'h2s')} a
            FULL JOIN {_kind_sql('view', 'nh3')} b ON a.ts = b.ts
            FULL JOIN {_kind_sql('click', 'flow')} c ON coalesce(a.ts, b.ts) = c.ts""",
        rounded="h2s nh3 flow",
    ),
)
def outer_merge_series(spark, d):
    parts = [_one_kind(spark, d, k, n) for k, n in (("error", "h2s"), ("view", "nh3"), ("click", "flow"))]
    return joins.outer_merge(parts, "ts")


@add(
    "daily_left_joins",
    sql(
        """SELECT a.day, price, n_items, n_events FROM
             (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1) a
           LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n_items FROM lineitem GROUP BY 1) b ON a.day = b.day
           LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n_events FROM events GROUP BY 1) c ON a.day = c.day""",
        rounded="price",
    ),
)
def daily_left_joins(spark, d):
    o, li, ev = (table(spark, d, n) for n in ("orders", "lineitem", "events"))
    base = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("price"))
    items = li.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n_items"))
    seen = ev.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_events"))
    return joins.add_daily(base, [items, seen], ["day"])


@add(
    "minutes_with_hour_totals",
    sql(
        """SELECT coalesce(m.ts, h.ts) AS ts, nh3_roll_mean_15min, lbs_volatile FROM
             (SELECT ts, nh3_roll_mean_15min FROM site WHERE nh3_roll_mean_15min IS NOT NULL) m
           FULL JOIN (SELECT CASE WHEN ts = date_trunc('hour', ts) THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS ts,
                        sum(lbs_per_min) AS lbs_volatile FROM loaded GROUP BY 1) h ON m.ts = h.ts""",
        "site loaded",
        "nh3_roll_mean_15min lbs_volatile",
    )
    .replace("site AS (", "site AS MATERIALIZED (")
    .replace("loaded AS (", "loaded AS MATERIALIZED ("),
)
def minutes_with_hour_totals(spark, d):
    site = site_minutes(spark, d)
    hours = rollup.hour_ending(dosing.loads(site, "ts"), "ts", sums={"lbs_volatile": "lbs_per_min"})
    signal = site.select("ts", "nh3_roll_mean_15min").where("nh3_roll_mean_15min IS NOT NULL")
    return joins.merge_on_time(signal, hours, "ts")


@add(
    "last_event_before",
    """SELECT v.event_id, v.ts, e.ts AS error_ts FROM (SELECT * FROM events WHERE event_type = 'view') v
       ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'error') e
         ON v.user_id = e.user_id AND v.ts >= e.ts""",
)
def last_event_before(spark, d):
    ev = table(spark, d, "events")
    views = ev.where("event_type = 'view'").select("user_id", "event_id", "ts")
    errors = ev.where("event_type = 'error'").select("user_id", "ts")
    return joins.last_event_before(views, "ts", errors, keys=["user_id"], name="error_ts").drop("user_id")


@add(
    "event_frames",
    sql(
        """SELECT f.chemical, f.event_type, f.ts AS event_ts, s.ts, s.nh3_roll_mean_15min, s.h2s_roll_max_15min,
             date_diff('second', f.ts, s.ts) / 60.0::DOUBLE AS minutes
           FROM found f JOIN site s ON s.ts BETWEEN f.ts - INTERVAL 48 HOUR AND f.ts + INTERVAL 48 HOUR""",
        "found site",
        "nh3_roll_mean_15min h2s_roll_max_15min minutes",
    ),
)
def event_frames(spark, d):
    site = site_minutes(spark, d)
    slim = site.select("ts", "nh3_roll_mean_15min", "h2s_roll_max_15min")
    return events.event_frames(slim, "ts", events.transitions(site, "ts"))


@add(
    "events_around_errors",
    """SELECT e.event_id AS error_id, count(*) AS n_near, min(x.ts) AS first_ts
       FROM (SELECT * FROM events WHERE event_type = 'error') e
       JOIN events x ON x.user_id = e.user_id AND x.ts BETWEEN e.ts - INTERVAL 60 MINUTE AND e.ts + INTERVAL 30 MINUTE
       GROUP BY 1""",
)
def events_around_errors(spark, d):
    ev = table(spark, d, "events")
    marks = ev.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    near = joins.around_events(ev.select("user_id", "ts"), "ts", marks, "error_ts", 60, 30, keys=["user_id"], span=90)
    return near.groupBy("error_id").agg(F.count(F.lit(1)).alias("n_near"), F.min("ts").alias("first_ts"))


@add(
    "stacked_tables",
    """SELECT kind, count(*) AS n, count(price) AS n_price, count(quantity) AS n_quantity FROM (
         SELECT 'order' AS kind, o_totalprice AS price, NULL AS quantity FROM orders
         UNION ALL SELECT 'item', l_extendedprice, l_quantity FROM lineitem
         UNION ALL SELECT 'part', p_retailprice, NULL FROM part) GROUP BY 1""",
)
def stacked_tables(spark, d):
    o, li, p = (table(spark, d, n) for n in ("orders", "lineitem", "part"))
    stacked = joins.stack(
        [
            o.select(F.lit("order").alias("kind"), F.col("o_totalprice").alias("price")),
            li.select(F.lit("item").alias("kind"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")),
            p.select(F.lit("part").alias("kind"), F.col("p_retailprice").alias("price")),
        ]
    )
    return stacked.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("n_price"), F.count("quantity").alias("n_quantity")
    )


@add(
    "long_and_wide_signals",
    sql(
        """SELECT CAST(ts AS DATE) AS day, max(nh3_roll_mean_15min) AS NH3, max(h2s_roll_max_15min) AS H2S FROM site GROUP BY 1""",
        "site",
        "NH3 H2S",
    ),
)
def long_and_wide_signals(spark, d):
    site = site_minutes(spark, d).withColumn("day", F.to_date("ts"))
    long = joins.to_long(site, ["day"], {"NH3": "nh3_roll_mean_15min", "H2S": "h2s_roll_max_15min"}, "signal", "value")
    return joins.to_wide(long, ["day"], "signal", "value", ["NH3", "H2S"])


