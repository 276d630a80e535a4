"""Registration, table loading, shared inputs, and the SQL text of those inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import col
from sensorloom.functions.timekit import bin_start
from sensorloom.operators.events import transitions
from sensorloom.operators.grid import filled_minutes, minute_grid
from sensorloom.session import prepare
from sensorloom.sources.tables import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
NUDGE = 1e-10
TIMES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")

            def run(spark: SparkSession, folder: str) -> DataFrame:
                return presentable(fn(prepare(spark), folder))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep

    def extend(self, other: Catalog) -> None:
        twice = self.queries.keys() & other.queries.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        self.queries.update(other.queries)
        self.sql.update(other.sql)


def presentable(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, whole numbers to bigint, instants to naive UTC time.

    The nudge keeps exact decimal ties from rounding apart in the two engines.
    """
    cells = []
    for n, t in df.dtypes:
        c = col(n)
        if t == "double":
            c = F.round(c + F.lit(NUDGE), 6) + F.lit(0.0)
        elif t in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif t == "timestamp":
            c = c.cast("timestamp_ntz")
        cells.append(c.alias(n))
    return df.select(cells)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    df = read_parquet(spark, path, TIMES.get(name))
    if df is None:
        raise FileNotFoundError(path)
    return df


# ----------------------------------------------------------- shared inputs
def signal_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_type").alias("k"), "ts", F.col("value").alias("v"))


def signal_grid(spark: SparkSession, folder: str) -> DataFrame:
    """``(k, ts, v)``: mean event value per type on the complete minute grid."""
    return minute_grid(signal_log(spark, folder), "ts", means=["v"], keys=["k"])


def filled_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The same with short gaps filled."""
    log = signal_log(spark, folder)
    return filled_minutes(log, "ts", means=["v"], keys=["k"], fill=["v"], limit=plant.GAP_LIMIT_MIN)


def site_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """One site: event types as gas and flow signals, dated states from 12-hour means."""
    ev = table(spark, folder, "events").select("ts", "event_type", "value")

    def of(kind: str):
        return F.when(F.col("event_type") == kind, F.col("value"))

    means = {
        plant.NH3: "view",
        plant.RAW_H2S: "error",
        plant.WEST: "click",
        plant.EAST: "purchase",
        plant.DIGESTER: "signup",
    }
    maxima = {plant.H2S: "error", plant.RAW_NH3: "view", plant.TEMP_NH3: "click", plant.TEMP_H2S: "signup"}
    wide = ev.select("ts", *[of(k).alias(n) for n, k in {**means, **maxima}.items()])
    grid = minute_grid(wide, "ts", means=list(means), maxima=list(maxima))
    states = ev.groupBy(bin_start("ts", 720).alias("block")).agg(
        (F.avg(of("click")) >= 50).cast("int").alias("ferric_available"),
        (F.avg(of("view")) >= 50).cast("int").alias("hcl_available"),
        (F.avg(of("error")) >= 40).cast("int").alias("sensor_valid"),
    )
    return grid.withColumn("block", bin_start("ts", 720)).join(states, "block", "left").drop("block")


def site_events(spark: SparkSession, folder: str) -> DataFrame:
    return transitions(site_minutes(spark, folder), "ts")


# ------------------------------------------------------- SQL of the inputs
_T = '"nh3_temperature_°f"', '"h2s_temperature_°f"'
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "bins": (
        (),
        "SELECT event_type AS k, date_trunc('minute', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2",
    ),
    "grid": (
        ("bins",),
        """SELECT g.k, g.ts, b.v FROM (
             SELECT k, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MINUTE)) AS ts FROM bins GROUP BY k) g
           LEFT JOIN bins b ON b.k = g.k AND b.ts = g.ts""",
    ),
    "neighbours": (
        ("grid",),
        """SELECT k, ts, v,
             last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER up AS pt,
             last_value(v IGNORE NULLS) OVER up AS pv,
             first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER down AS nt,
             first_value(v IGNORE NULLS) OVER down AS nv
           FROM grid
           WINDOW up AS (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  down AS (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ),
    "filled": (
        ("neighbours",),
        """SELECT k, ts, CASE WHEN v IS NOT NULL THEN v
             WHEN date_diff('minute', pt, ts) <= 10 THEN
               coalesce(pv + (nv - pv) * date_diff('minute', pt, ts) / nullif(date_diff('minute', pt, nt), 0), pv)
             END AS v FROM neighbours""",
    ),
    "site": (
        (),
        f"""SELECT g.ts, p.* EXCLUDE (ts), s.* EXCLUDE (block) FROM (
             SELECT unnest(generate_series(date_trunc('minute', min(ts)), date_trunc('minute', max(ts)),
                           INTERVAL 1 MINUTE)) AS ts FROM events) g
           LEFT JOIN (SELECT date_trunc('minute', ts) AS ts,
               avg(value) FILTER (event_type = 'view') AS nh3_roll_mean_15min,
               avg(value) FILTER (event_type = 'error') AS h2s_h2s_ppm,
               avg(value) FILTER (event_type = 'click') AS west_sludge_out_gpm,
               avg(value) FILTER (event_type = 'purchase') AS east_sludge_out_gpm,
               avg(value) FILTER (event_type = 'signup') AS digesters_sludge_out_flow,
               max(value) FILTER (event_type = 'error') AS h2s_roll_max_15min,
               max(value) FILTER (event_type = 'view') AS nh3_nh3_ppm,
               max(value) FILTER (event_type = 'click') AS {_T[0]},
               max(value) FILTER (event_type = 'signup') AS {_T[1]}
             FROM events GROUP BY 1) p ON p.ts = g.ts
           LEFT JOIN (SELECT time_bucket(INTERVAL 12 HOURS, ts) AS block,
               CAST(avg(value) FILTER (event_type = 'click') >= 50 AS INT) AS ferric_available,
               CAST(avg(value) FILTER (event_type = 'view') >= 50 AS INT) AS hcl_available,
               CAST(avg(value) FILTER (event_type = 'error') >= 40 AS INT) AS sensor_valid
             FROM events GROUP BY 1) s ON s.block = time_bucket(INTERVAL 12 HOURS, g.ts)""",
    ),
    "loaded": (
        ("site",),
        """SELECT *, total_gpm * 7.596072 AS lbs_per_min,
             nh3_roll_mean_15min / (total_gpm * 7.596072 + 1e-9) AS nh3_per_lb,
             h2s_roll_max_15min / (total_gpm * 7.596072 + 1e-9) AS h2s_per_lb
           FROM (SELECT *, west_sludge_out_gpm + east_sludge_out_gpm + digesters_sludge_out_flow AS total_gpm
             FROM (SELECT * REPLACE (
               coalesce(last_value(west_sludge_out_gpm IGNORE NULLS) OVER w, 0.0) AS west_sludge_out_gpm,
               coalesce(last_value(east_sludge_out_gpm IGNORE NULLS) OVER w, 0.0) AS east_sludge_out_gpm,
               coalesce(last_value(digesters_sludge_out_flow IGNORE NULLS) OVER w, 0.0) AS digesters_sludge_out_flow)
             FROM site WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""",
    ),
    "states": (
        ("site",),
        """SELECT ts, 'Ferric' AS chemical, coalesce(ferric_available, 0) AS s FROM site
           UNION ALL SELECT ts, 'HCl', coalesce(hcl_available, 0) FROM site""",
    ),
    "found": (
        ("states",),
        """SELECT ts, chemical, CASE WHEN d = 1 THEN 'ON' ELSE 'OFF' END AS event_type
           FROM (SELECT *, s - lag(s) OVER (PARTITION BY chemical ORDER BY ts) AS d FROM states)
           WHERE d IN (1, -1)""",
    ),
    "signals": (
        ("site",),
        """SELECT ts, 'NH3' AS signal, nh3_roll_mean_15min AS value FROM site
           UNION ALL SELECT ts, 'H2S', h2s_roll_max_15min FROM site""",
    ),
    "single": (
        ("found", "signals"),
        """SELECT * FROM (SELECT chemical, event_type, event_ts, signal, any_value(base) AS baseline,
               median(value) FILTER (post) AS post,
               median(value) FILTER (post) - any_value(base) AS delta,
               100 * (median(value) FILTER (post) - any_value(base)) / nullif(any_value(base), 0) AS percent_change,
               arg_min(rel, (value, rel)) FILTER (post) AS time_to_min,
               coalesce(max(rel) FILTER (post AND value < base) - min(rel) FILTER (post AND value < base), 0)
                 AS persistence,
               quantile_cont(value, 0.75::DOUBLE) FILTER (post) - quantile_cont(value, 0.25::DOUBLE) FILTER (post)
                 AS post_iqr,
               count(*) FILTER (NOT post) AS n_pre, count(*) FILTER (post) AS n_post
             FROM (SELECT *, median(value) FILTER (NOT post) OVER (
                     PARTITION BY chemical, event_type, event_ts, signal) AS base
               FROM (SELECT e.chemical, e.event_type, e.ts AS event_ts, s.signal, s.value,
                       date_diff('minute', e.ts, s.ts) AS rel, date_diff('minute', e.ts, s.ts) >= 720 AS post
                     FROM found e JOIN signals s ON s.value IS NOT NULL
                      AND (s.ts BETWEEN e.ts - INTERVAL 2880 MINUTE AND e.ts - INTERVAL 720 MINUTE
                        OR s.ts BETWEEN e.ts + INTERVAL 720 MINUTE AND e.ts + INTERVAL 5760 MINUTE)))
             GROUP BY ALL_KEYS) WHERE n_pre > 0 AND n_post > 0""".replace("ALL_KEYS", "1, 2, 3, 4"),
    ),
    "metrics": (
        ("single",),
        """SELECT chemical, event_type, signal, median(baseline) AS baseline, median(post) AS post,
             median(delta) AS delta, median(percent_change) AS percent_change,
             median(time_to_min::DOUBLE) AS time_to_min, median(persistence::DOUBLE) AS persistence,
             median(post_iqr) AS post_iqr, count(*) AS n_events
           FROM single GROUP BY 1, 2, 3""",
    ),
    "aligned": (
        ("found", "site"),
        """SELECT e.chemical, e.event_type, e.ts AS event_ts,
             CAST(trunc(date_diff('second', e.ts, s.ts) / 60.0) AS BIGINT) AS rel_min, s.nh3_roll_mean_15min AS value
           FROM found e JOIN site s ON s.ts BETWEEN e.ts - INTERVAL 4320 MINUTE AND e.ts + INTERVAL 4320 MINUTE""",
    ),
    "study": (
        ("aligned",),
        """SELECT chemical, event_type, rel_min, median(value) AS median,
             quantile_cont(value, 0.25::DOUBLE) AS q25, quantile_cont(value, 0.75::DOUBLE) AS q75,
             count(value) AS n_values FROM aligned GROUP BY 1, 2, 3""",
    ),
    "site_daily": (
        ("site",),
        """SELECT *, n_obs_nh3 / 1440.0::DOUBLE AS nh3_coverage, n_obs_h2s / 1440.0::DOUBLE AS h2s_coverage,
             n_obs_water / 1440.0::DOUBLE AS water_coverage
           FROM (SELECT CAST(ts AS DATE) AS day, avg(nh3_roll_mean_15min) AS nh3_roll_mean_15min,
               max(h2s_roll_max_15min) AS h2s_roll_max_15min, avg(east_sludge_out_gpm) AS east_sludge_out_gpm,
               avg(west_sludge_out_gpm) AS west_sludge_out_gpm,
               avg(digesters_sludge_out_flow) AS digesters_sludge_out_flow,
               max(ferric_available) AS ferric_available, max(hcl_available) AS hcl_available,
               stddev_samp(h2s_roll_max_15min) AS h2s_std, stddev_samp(nh3_roll_mean_15min) AS nh3_std,
               avg(flow) AS total_gpm, sum(flow * 7.596072) AS transferred_lbs_vol_daily,
               count(nh3_roll_mean_15min) AS n_obs_nh3, count(h2s_roll_max_15min) AS n_obs_h2s,
               count(east_sludge_out_gpm) AS n_obs_water
             FROM (SELECT *, coalesce(west_sludge_out_gpm, 0.0) + coalesce(east_sludge_out_gpm, 0.0)
                     + coalesce(digesters_sludge_out_flow, 0.0) AS flow FROM site)
             GROUP BY 1) WHERE n_obs_nh3 + n_obs_h2s + n_obs_water > 0""",
    ),
}


def sql(body: str, uses: str = "", rounded: str = "") -> str:
    """Prefix the named inputs as CTEs and round the listed double columns to 6 decimals."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in PARTS[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in uses.split():
        need(name)
    ctes = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    if rounded:
        marks = ", ".join(f"round(CAST({c} AS DOUBLE) + {NUDGE}::DOUBLE, 6) + 0.0 AS {c}" for c in rounded.split())
        body = f"SELECT * REPLACE ({marks}) FROM ({body})"
    return f"WITH {ctes}\n{body}" if ctes else body
