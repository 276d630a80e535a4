"""Log and export parsing. The lines are made from the events table by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.catalog.base import Catalog, sql, table
from sensorloom.functions.names import fix_spelling
from sensorloom.operators.clean import clip_time, coerce
from sensorloom.operators.report import table_range
from sensorloom.sources import delimited as dl
from sensorloom.sources.sinks import settle, shared_folder, write_lines
from sensorloom.sources.tables import check_optional_table, parse_optional_dates

CATALOG = Catalog()
add = CATALOG.add


def _with_top(data: DataFrame, top: list[str]) -> DataFrame:
    """Put fixed top lines before the data lines ``(file, seq, line)`` of every file."""
    heads = data.select("file").distinct().select(
        "file", F.posexplode(F.array(*[F.lit(t) for t in top])).alias("seq", "line")
    )
    rows = heads.select("file", F.col("seq").cast("long"), "line").unionByName(
        data.select("file", (F.col("seq") + len(top)).cast("long").alias("seq"), "line")
    )
    return rows.withColumn("block", F.lit(0).cast("long")).select("file", "block", "seq", "line")


def _as_files(lines: DataFrame) -> str:
    """Write the lines as text files; returns what the loaders take."""
    place = f"{shared_folder(lines.sparkSession)}/exports-{uuid.uuid4().hex}"
    write_lines(lines, place, ["block", "seq"])
    return f"{place}/*"


def _type_and_day() -> Column:
    """A file for each event type and day, so that no file grows with the record."""
    return F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMdd"))


def logger_lines(spark, d, file: str | Column = "event_type") -> DataFrame:
    """One gas logger file per event type, or per ``file``: preamble, header, quoted times."""
    ev = table(spark, d, "events")
    line = F.concat(
        F.lit('"'), F.date_format("ts", "M-d-yyyy, h-mm-ss a"), F.lit('",'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(","), F.col("value").cast("string"), F.lit(","), F.col("user_id").cast("string"),
    )
    data = ev.select((F.col(file) if isinstance(file, str) else file).alias("file"), F.col("event_id").alias("seq"), line.alias("line"))
    preamble = [f"Device setting {i}" for i in range(plant.PREAMBLE_LINES)]
    return _with_top(data, [*preamble, "Time Stamp,ISO time,Gas Level (PPM),User"])


_LOGGED = sql(
    """SELECT ts, isotime AS gas_iso_time, value AS gas_gas_level_ppm, user_id AS gas_user FROM (
         SELECT date_trunc('second', ts) AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS isotime, value, user_id,
           row_number() OVER (PARTITION BY date_trunc('second', ts) ORDER BY event_type, event_id) AS r FROM events)
       WHERE r = 1""",
    rounded="gas_gas_level_ppm gas_user",
)


@add("sensor_log_load", _LOGGED)
def sensor_log_load(spark, d):
    lines = logger_lines(spark, d)
    parsed = dl.parse_lines(lines, settle(dl.fixed_header(lines)), time_label="Time Stamp", prefix="gas_")
    return coerce(dl.one_per_time(parsed), ["gas_gas_level_ppm", "gas_user"], [])


@add("sensor_log_files", _LOGGED)
def sensor_log_files(spark, d):
    """The same logs, a text file for each type and day, through the loader: lines are read, numbered and parsed."""
    path = _as_files(logger_lines(spark, d, _type_and_day()))
    return coerce(dl.load_sensor_logs(spark, path, "gas_"), ["gas_gas_level_ppm", "gas_user"], [])


def export_lines(spark, d, file: str | Column = "event_type") -> DataFrame:
    """Plant flow exports with a generic first header row and a misspelt real one."""
    ev = table(spark, d, "events")
    line = F.concat_ws(",", F.date_format("ts", "M/d/yy h:mm:ss a"), F.col("value").cast("string"), F.col("user_id").cast("string"))
    data = ev.select((F.col(file) if isinstance(file, str) else file).alias("file"), F.col("event_id").alias("seq"), line.alias("line"))
    return _with_top(
        data,
        ["Time,Digesters Sludge Out Flow,Unnamed: 2", "Time,West Sludge Out (GPM),Eest Sludge Out (GPM)"],
    )


_EXPORTED = sql(
    """SELECT ts, value AS west_sludge_out_gpm, CAST(user_id AS DOUBLE) AS east_sludge_out_gpm FROM (
         SELECT date_trunc('second', ts) AS ts, value, user_id,
           row_number() OVER (PARTITION BY date_trunc('second', ts) ORDER BY event_type, event_id) AS r FROM events)
       WHERE r = 1""",
    rounded="west_sludge_out_gpm east_sludge_out_gpm",
)


@add("flow_export_load", _EXPORTED)
def flow_export_load(spark, d):
    lines = export_lines(spark, d)
    parsed = dl.one_per_time(dl.parse_lines(lines, settle(dl.best_header(lines)), time_label="Time"))
    named = fix_spelling(parsed, plant.MISSPELT)
    return coerce(named, [plant.WEST, plant.EAST], [])


@add("flow_export_files", _EXPORTED)
def flow_export_files(spark, d):
    """The same exports, a text file for each type and day, through the loader."""
    path = _as_files(export_lines(spark, d, _type_and_day()))
    return coerce(fix_spelling(dl.load_flow_exports(spark, path), plant.MISSPELT), [plant.WEST, plant.EAST], [])


@add(
    "header_row_choice",
    """SELECT f AS file, CAST(CASE kind WHEN 'best' THEN 1 WHEN 'marker' THEN 8 ELSE 0 END AS BIGINT) AS header_no, kind
       FROM (SELECT DISTINCT event_type AS f FROM events), (VALUES ('best'), ('marker'), ('default')) v(kind)""",
)
def header_row_choice(spark, d):
    exports, logs = export_lines(spark, d), logger_lines(spark, d)
    best = dl.best_header(exports).withColumn("kind", F.lit("best"))
    marker = dl.marker_header(logs).withColumn("kind", F.lit("marker"))
    default = dl.marker_header(exports).withColumn("kind", F.lit("default"))
    return best.unionByName(marker).unionByName(default).select("file", "header_no", "kind")


def flawed_lines(spark, d) -> DataFrame:
    """Exports with repeated headers, broken times in one file and no good time in another."""
    ev = table(spark, d, "events")
    good = F.date_format("ts", "M/d/yy h:mm:ss a")
    when = (
        F.when(F.col("event_type") == "signup", F.lit("no time"))
        .when((F.col("event_type") == "error") & (F.col("value") > 100), F.lit("99/99/99 0:00:00 XM"))
        .when((F.col("event_type") == "view") & (F.col("value") < 10), F.lit("Time"))
        .otherwise(good)
    )
    line = F.concat_ws(",", when, F.col("value").cast("string"))
    data = ev.select(F.col("event_type").alias("file"), F.col("event_id").alias("seq"), line.alias("line"))
    return _with_top(data, ["Time,West Sludge Out (GPM)"])


@add(
    "load_quality_tables",
    """SELECT f AS file, n AS rows, lo AS "start", hi AS "end", CAST(CASE WHEN n > 0 THEN 2 END AS BIGINT) AS columns_present,
         bad AS bad_rows, CASE WHEN n IS NULL THEN 'No valid timestamp rows.' END AS reason,
         TRUE AS has_time, FALSE AS has_east
       FROM (SELECT event_type AS f, nullif(count(*) FILTER (good), 0) AS n,
               min(date_trunc('second', ts)) FILTER (good) AS lo, max(date_trunc('second', ts)) FILTER (good) AS hi,
               count(*) FILTER (bad) AS bad
             FROM (SELECT *, event_type = 'signup' OR (event_type = 'error' AND value > 100) AS bad,
                     NOT (event_type = 'signup' OR (event_type = 'error' AND value > 100)
                       OR (event_type = 'view' AND value < 10)) AS good FROM events) GROUP BY 1)""",
)
def load_quality_tables(spark, d):
    lines = flawed_lines(spark, d)
    t = dl.quality_tables(
        lines, settle(dl.first_cell_header(lines)), time_label="Time", expected=["Time", "East Sludge Out (GPM)"]
    )
    bad = t["bad_rows"].groupBy("file").agg(F.count(F.lit(1)).alias("bad_rows"))
    presence = t["presence"].select(
        "file", F.col("Time").alias("has_time"), F.col("`East Sludge Out (GPM)`").alias("has_east")
    )
    out = presence.join(t["diagnostics"], "file", "left").join(bad, "file", "left").join(t["skipped"], "file", "left")
    return out.withColumn("bad_rows", F.coalesce("bad_rows", F.lit(0)))


@add(
    "time_range_scan",
    sql(
        """SELECT event_id, ts, value FROM events
           WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00' AND TIMESTAMP '2024-01-12 23:59'""",
        rounded="value",
    ),
)
def time_range_scan(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return clip_time(ev, "ts", "2024-01-10 00:00", "2024-01-12 23:59").select("event_id", "ts", "value")


@add(
    "optional_table_dates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS date,
         CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 90 MINUTE END AS sample_time FROM orders""",
)
def optional_table_dates(spark, d):
    o = table(spark, d, "orders")
    text = o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "bad-date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(
            F.col("o_orderstatus") == "O",
            F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES"), "M/d/yy h:mm:ss a"),
        ).alias("sample_time"),
    )
    return parse_optional_dates(text)


@add(
    "optional_table_check",
    """SELECT * FROM (VALUES
         ('Struvite Observations', TRUE, '', 'coupon_result,notes'),
         ('Chemistry Lab Results', FALSE, 'alkalinity|mg|nh4|pH|po4', 'sample_location,notes')
       ) v(title, is_valid, missing_groups, missing_recommended) WHERE EXISTS (SELECT 1 FROM orders)""",
)
def optional_table_check(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("location")
    )
    both = check_optional_table(o, "Struvite Observations").unionByName(check_optional_table(o, "Chemistry Lab Results"))
    groups = F.array_join(F.transform("missing_required_groups", lambda g: F.array_join(g, "|")), ",")
    return both.select(
        "title", "is_valid", groups.alias("missing_groups"), F.array_join("missing_recommended", ",").alias("missing_recommended")
    )


@add(
    "table_range",
    """SELECT event_type, count(*) AS n_rows, min(ts) AS "start", max(ts) AS "end" FROM events GROUP BY 1""",
)
def table_range_query(spark, d):
    return table_range(table(spark, d, "events"), "ts", keys=["event_type"])
