"""Correlation, trend, phase comparison, distribution, report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.catalog.base import Catalog, site_events, site_minutes, sql, table
from sensorloom.operators import dosing, report, stats
from sensorloom.operators.quantiles import exact_quantiles

CATALOG = Catalog()
add = CATALOG.add

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat"]


def _items(spark, d):
    return table(spark, d, "lineitem").withColumn("flat", F.lit(3.0))


def _corr(a, b):
    if "flat" in (a, b):
        return "max(NULL::DOUBLE)"
    return f"corr({a}, {b})"


@add(
    "correlation_matrix",
    sql(
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b)} AS r FROM lineitem" for a in _NUM for b in _NUM),
        rounded="r",
    ),
)
def correlation_matrix(spark, d):
    return stats.correlation_matrix(_items(spark, d), _NUM)


@add(
    "pairwise_complete_correlation",
    sql(
        """SELECT 'nh3' AS a, 'h2s' AS b, corr(x, y) AS r FROM (
             SELECT CASE WHEN l_quantity < 40 THEN l_quantity END AS x, CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS y
             FROM lineitem)""",
        rounded="r",
    ),
)
def pairwise_complete_correlation(spark, d):
    li = table(spark, d, "lineitem").select(
        F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("nh3"),
        F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("h2s"),
    )
    return stats.correlation_matrix(li, ["nh3", "h2s"]).where("a = 'nh3' AND b = 'h2s'")


@add(
    "correlation_matrix_wide_and_long",
    sql(
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr(a, b)} AS r FROM lineitem" for a in _NUM[:3] for b in _NUM[:3]),
        rounded="r",
    ),
)
def correlation_matrix_wide_and_long(spark, d):
    wide = stats.matrix_to_wide(stats.correlation_matrix(_items(spark, d), _NUM[:3]), _NUM[:3])
    return stats.matrix_to_long(wide, _NUM[:3])


@add(
    "target_correlation",
    sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS feature, {_corr(a, 'l_extendedprice')} AS r, abs({_corr(a, 'l_extendedprice')}) AS abs_r FROM lineitem"
            for a in ("l_quantity", "l_discount", "l_tax", "flat")
        ),
        rounded="r abs_r",
    ),
)
def target_correlation(spark, d):
    return stats.target_correlation(_items(spark, d), ["l_quantity", "l_discount", "l_tax", "flat"], "l_extendedprice")


_LAGGED = f"""SELECT lag, r, coalesce(lag = first_value(lag) OVER (ORDER BY abs(r) DESC NULLS LAST, lag), FALSE) AS best FROM (
  {' UNION ALL '.join(f"SELECT {n}::BIGINT AS lag, corr(s, d{n}) AS r FROM lagged" for n in range(15))})"""


@add(
    "lagged_correlation",
    """WITH days AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS signal, count(*) AS dose FROM orders
         WHERE o_orderdate >= '1996-09-17' GROUP BY 1),
       lagged AS (SELECT avg(signal) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, """
    + ", ".join(f"lag(dose, {n}) OVER (ORDER BY day) AS d{n}" for n in range(15))
    + " FROM days)\n"
    + sql(_LAGGED, rounded="r"),
)
def lagged_correlation(spark, d):
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.avg("o_totalprice").alias("signal"), F.count(F.lit(1)).alias("dose")
    )
    return stats.lagged_correlation(daily, "day", "signal", "dose", start="1996-09-17")


@add(
    "linear_trend",
    sql(
        """SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
             regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem GROUP BY 1""",
        rounded="slope intercept r2",
    ),
)
def linear_trend(spark, d):
    return stats.linear_trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", by=["l_returnflag"])


_WELCH = """m AS (SELECT variable, phase, avg(v) AS m, var_samp(v) AS s2, count(v) AS n FROM (
             SELECT l_returnflag AS phase, 'l_quantity' AS variable, l_quantity AS v FROM lineitem
             UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1, 2),
           tested AS (SELECT a.variable, a.phase AS phase_a, b.phase AS phase_b, (a.m - b.m) / sqrt(a.s2 / a.n + b.s2 / b.n) AS t,
             (a.s2 / a.n + b.s2 / b.n) ** 2 / ((a.s2 / a.n) ** 2 / (a.n - 1) + (b.s2 / b.n) ** 2 / (b.n - 1)) AS df
           FROM m a JOIN m b ON a.variable = b.variable AND a.phase < b.phase)"""
_PANELS = 4000


@add("welch_t_tests", sql(f"WITH {_WELCH} SELECT * FROM tested", rounded="t df"))
def welch_t_tests(spark, d):
    return stats.welch_tests(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"], p_values=False)


# the twin integrates the density from 0 to |t| by Simpson's rule
@add(
    "welch_p_values",
    sql(
        f"""WITH {_WELCH},
           places AS (SELECT *, unnest(range({_PANELS + 1})) AS i FROM tested),
           weighted AS (SELECT *, CASE WHEN i IN (0, {_PANELS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
             * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - (df + 1) / 2 * ln(1 + (t * i / {_PANELS}) ** 2 / df)) AS w
             FROM places)
           SELECT *, p < 0.05 AS significant
           FROM (SELECT variable, phase_a, phase_b, t, df, greatest(1 - 2 * sum(w) * abs(t) / {_PANELS} / 3, 0.0) AS p
                 FROM weighted GROUP BY 1, 2, 3, 4, 5)""",
        rounded="t df p",
    ),
)
def welch_p_values(spark, d):
    return stats.welch_tests(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])


@add(
    "on_off_means",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{v}' AS variable, '{n}' AS chemical, off_mean, on_mean, 100 * (off_mean - on_mean) / nullif(on_mean, 0) AS change_pct
                FROM (SELECT avg({v}) FILTER (f = 1) AS off_mean, avg({v}) FILTER (f = 0) AS on_mean
                      FROM (SELECT *, CAST({c} AS INT) AS f FROM lineitem))"""
            for v in ("l_quantity", "l_extendedprice")
            for n, c in (("HCl", "l_discount > 0.05"), ("Ferric", "l_shipdate BETWEEN '1996-09-09' AND '1997-09-17'"))
        ),
        rounded="off_mean on_mean change_pct",
    ),
)
def on_off_means(spark, d):
    li = table(spark, d, "lineitem").withColumns(
        {
            "hcl_off": (F.col("l_discount") > 0.05).cast("int"),
            "ferric_off": dosing.closed_flag("l_shipdate", "1996-09-09", "1997-09-17"),
        }
    )
    return stats.on_off_means(li, {"HCl": "hcl_off", "Ferric": "ferric_off"}, ["l_quantity", "l_extendedprice"])


@add(
    "phase_extent",
    """SELECT CASE WHEN l_shipdate < '1997-01-01' THEN 'before' WHEN l_shipdate < '1999-01-01' THEN 'during' ELSE 'after' END AS phase,
         count(*) AS n, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day
       FROM lineitem GROUP BY 1""",
)
def phase_extent(spark, d):
    cuts = [("before", "1997-01-01"), ("during", "1999-01-01"), ("after", None)]
    li = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), dosing.phase("l_shipdate", cuts).alias("label"))
    return stats.phase_extent(li, "label", "day")


@add(
    "box_summary",
    sql(
        """SELECT l_returnflag AS phase, count(*) AS n, min(v) AS low, quantile_cont(v, 0.25::DOUBLE) AS q1, median(v) AS median,
             quantile_cont(v, 0.75::DOUBLE) AS q3, max(v) AS high, avg(v) AS mean, stddev_samp(v) AS sd,
             (SELECT max(l_extendedprice) > 10 * median(l_extendedprice) FROM lineitem) AS log_axis
           FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY 1""",
        rounded="low q1 median q3 high mean sd",
    ),
)
def box_summary(spark, d):
    return stats.box_summary(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", stored=True)


@add(
    "focused_axis_range",
    sql(
        """SELECT CASE WHEN hi > lo THEN lo - (hi - lo) * 0.08::DOUBLE END AS range_low,
             CASE WHEN hi > lo THEN hi + (hi - lo) * 0.08::DOUBLE END AS range_high, m > 0 AS log_allowed
           FROM (SELECT quantile_cont(value, 0.02::DOUBLE) AS lo, quantile_cont(value, 0.98::DOUBLE) AS hi, min(value) AS m FROM events)""",
        rounded="range_low range_high",
    ),
)
def focused_axis_range(spark, d):
    return stats.axis_range(table(spark, d, "events"), "value", stored=True)


@add(
    "exact_quantiles_by_group",
    sql(
        """SELECT event_type, quantile_cont(value, 0.01::DOUBLE) AS q01, median(value) AS q50, quantile_cont(value, 0.99::DOUBLE) AS q99
           FROM events GROUP BY 1""",
        rounded="q01 q50 q99",
    ),
)
def exact_quantiles_by_group(spark, d):
    return exact_quantiles(
        table(spark, d, "events"), "value", [0.01, 0.5, 0.99], by=["event_type"], names=["q01", "q50", "q99"], stored=True
    )


@add(
    "value_histogram",
    sql(
        """SELECT b.bin, lo + b.bin * w AS bin_low, lo + (b.bin + 1) * w AS bin_high, coalesce(n, 0) AS n
           FROM (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS w FROM orders) e,
             (SELECT unnest(range(50)) AS bin) b
           LEFT JOIN (SELECT least(CAST(floor((o_totalprice - lo) / w) AS BIGINT), 49) AS bin, count(*) AS n
                      FROM orders, (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS w FROM orders)
                      GROUP BY 1) c ON c.bin = b.bin""",
        rounded="bin_low bin_high",
    ),
)
def value_histogram(spark, d):
    return stats.histogram(table(spark, d, "orders"), "o_totalprice")


@add(
    "metric_and_coverage",
    sql(
        """SELECT CAST(ts AS DATE) AS day, avg(nh3_roll_mean_15min) AS nh3_mean, max(h2s_roll_max_15min) AS h2s_max,
             CASE WHEN count(nh3_roll_mean_15min) > 0 THEN count(nh3_roll_mean_15min) * 100.0::DOUBLE / 1440 END AS nh3_coverage_pct
           FROM site GROUP BY 1""",
        "site",
        "nh3_mean h2s_max nh3_coverage_pct",
    ),
)
def metric_and_coverage(spark, d):
    return site_minutes(spark, d).groupBy(F.to_date("ts").alias("day")).agg(
        report.metric(plant.NH3).alias("nh3_mean"),
        report.metric(plant.H2S, "max").alias("h2s_max"),
        report.coverage_pct(plant.NH3, 1440).alias("nh3_coverage_pct"),
    )


_DIRECTION = "CASE WHEN {d} > 0 THEN 'up' WHEN {d} < 0 THEN 'down' WHEN {d} = 0 THEN 'flat' END"


@add(
    "window_summary",
    sql(
        f"""SELECT *, {_DIRECTION.format(d='nh3_delta')} AS nh3_direction, {_DIRECTION.format(d='h2s_delta')} AS h2s_direction,
              (SELECT count(*) FROM found) AS transitions
            FROM (SELECT CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, count(*) AS n_rows,
                avg(total_gpm) AS mean_flow, count(nh3_roll_mean_15min) * 100.0::DOUBLE / count(*) AS nh3_coverage_pct,
                arg_max(nh3_roll_mean_15min, ts) - arg_min(nh3_roll_mean_15min, ts) AS nh3_delta,
                count(h2s_roll_max_15min) * 100.0::DOUBLE / count(*) AS h2s_coverage_pct,
                arg_max(h2s_roll_max_15min, ts) - arg_min(h2s_roll_max_15min, ts) AS h2s_delta FROM loaded)""",
        "loaded found",
        "mean_flow nh3_coverage_pct nh3_delta h2s_coverage_pct h2s_delta",
    ),
)
def window_summary(spark, d):
    return report.window_summary(dosing.loads(site_minutes(spark, d), "ts"), "ts", site_events(spark, d))


@add(
    "chemistry_review",
    sql(
        """SELECT 'Ferric solution feed context' AS workflow_element, 'Available as secondary context' AS status, median(f) AS median,
             'lb/day' AS unit FROM dosed
           UNION ALL SELECT 'HCl solution feed context', 'Available as secondary context', median(h), 'lb/day' FROM dosed
           UNION ALL SELECT 'Ferric dose intensity', 'Primary interpretation metric', median(f * 0.379::DOUBLE / q) FILTER (q > 0), 'mg/L' FROM dosed
           UNION ALL SELECT 'HCl dose intensity', 'Primary interpretation metric', median(h * 0.32::DOUBLE / q) FILTER (q > 0), 'mg/L' FROM dosed
           UNION ALL SELECT 'Fixed chemistry context', 'Available', 7.0, 'pH'
           UNION ALL SELECT 'Ferric reduction date', 'Available', NULL, '2026-01-07'
           UNION ALL SELECT 'HCl dosing features', 'Available', NULL, 'hcl_solution_lbs_per_day, hcl_active_lbs_per_day'""",
        "loaded",
        "median",
    ).replace(
        "\nSELECT * REPLACE",
        """, dosed AS (SELECT coalesce(ferric_available, 0) * 583.0::DOUBLE AS f, coalesce(hcl_available, 0) * 6230.0::DOUBLE AS h,
             total_gpm * 1440 / 1000000.0::DOUBLE * 8.34::DOUBLE AS q FROM loaded)\nSELECT * REPLACE""",
    ),
)
def chemistry_review(spark, d):
    return report.chemistry_review(dosing.enrich(site_minutes(spark, d), "ts"))


_PROFILE = """SELECT '{p}' AS part, {e} AS slot, count(*) AS n, avg(value) AS value_mean, max(value) AS value_max
  FROM events WHERE value / 1000 <= 0.05 GROUP BY 2"""


@add(
    "low_flow_profile",
    sql(
        _PROFILE.format(p="hour", e="hour(ts)") + " UNION ALL " + _PROFILE.format(p="weekday", e="isodow(ts) - 1"),
        rounded="value_mean value_max",
    ),
)
def low_flow_profile(spark, d):
    low = F.col("value") / 1000 <= plant.LOW_FLOW_MGD
    hours, days = stats.hour_and_weekday_profile(table(spark, d, "events"), low, "ts", ["value"])
    return hours.select(F.lit("hour").alias("part"), F.col("hour").alias("slot"), "n", "value_mean", "value_max").unionByName(
        days.select(F.lit("weekday").alias("part"), F.col("weekday").alias("slot"), "n", "value_mean", "value_max")
    )


