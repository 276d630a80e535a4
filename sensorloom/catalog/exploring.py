"""Top rows and dataset status."""

from __future__ import annotations

from sensorloom.catalog.base import Catalog, filled_grid, site_minutes, sql, table
from sensorloom.operators import features, report, rollup

CATALOG = Catalog()
add = CATALOG.add


@add(
    "explorer_top_rows",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""",
)
def explorer_top_rows(spark, d):
    return report.top_rows(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"], sort="o_totalprice")


@add(
    "latest_z_scores",
    sql(
        """SELECT k, ts, v, z_score FROM (SELECT k, ts, v, CASE WHEN n >= 144 AND sd > 0 THEN (v - mean) / sd END AS z_score FROM (
             SELECT k, ts, v, count(v) OVER o AS n, avg(v) OVER o AS mean, stddev_samp(v) OVER o AS sd FROM filled
             WINDOW o AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW)))
           WHERE z_score IS NOT NULL ORDER BY ts DESC, k LIMIT 5000""",
        "filled",
        "v z_score",
    ),
)
def latest_z_scores(spark, d):
    scored = features.zscore(filled_grid(spark, d), "ts", "v", keys=["k"]).where("z_score IS NOT NULL")
    return report.latest_rows(scored.select("k", "ts", "v", "z_score"), "ts", ties=["k"])


@add(
    "dataset_status",
    sql(
        """SELECT 'minute' AS dataset, count(*) AS n_rows, count(nh3_roll_mean_15min) * 100.0::DOUBLE / count(*) AS nh3_coverage_pct,
             count(h2s_roll_max_15min) * 100.0::DOUBLE / count(*) AS h2s_coverage_pct, TRUE AS present FROM site
           UNION ALL SELECT 'daily', count(*), count(nh3_roll_mean_15min) * 100.0::DOUBLE / count(*),
             count(h2s_roll_max_15min) * 100.0::DOUBLE / count(*), TRUE FROM site_daily
           UNION ALL SELECT 'orders', count(*), NULL, NULL, TRUE FROM orders
           UNION ALL SELECT 'struvite', 0, NULL, NULL, FALSE""",
        "site site_daily",
        "nh3_coverage_pct h2s_coverage_pct",
    ),
)
def dataset_status(spark, d):
    minutes = site_minutes(spark, d)
    return report.dataset_status(
        {"minute": minutes, "daily": rollup.plant_daily(minutes, "ts"), "orders": table(spark, d, "orders"), "struvite": None}
    )


