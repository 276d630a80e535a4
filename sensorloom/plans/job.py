"""The build as one job: from parsed logs to the folder that ``Analysis.open`` reads.

``build_all`` writes everything; ``rebuild`` brings a folder up to date after some days of the logs changed. Values of a
minute depend on the observations of each column before and after it, on no others, and on the hour of values before it.
So a rebuild looks up those observations, makes the minutes between them again, and replaces just their dates.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions import names as nm
from sensorloom.functions.names import col
from sensorloom.operators import dosing, events, rollup
from sensorloom.operators.clean import coerce
from sensorloom.operators.joins import outer_merge
from sensorloom.plans.build import clean_names, minute_table
from sensorloom.sources.sinks import write_csv, write_dates, write_minutes, write_small
from sensorloom.sources.tables import read_parquet

#: Minutes of values before it that a minute looks back on.
REACH = max(*plant.LAGS_MIN, *plant.ROLLS_MIN)


def build_all(tables: Sequence[DataFrame], path: str, ts: str = "ts") -> None:
    """Minutes by date, hours and days by date, period summaries, events and their metrics."""
    write_minutes(dosing.enrich(minute_table(tables, ts), ts), f"{path}/minute", ts)
    _summaries(tables[0].sparkSession, path, ts, None)


def rebuild(tables: Sequence[DataFrame], path: str, first: date, last: date, ts: str = "ts") -> tuple[date, date]:
    """Replace what the logs of ``first`` to ``last`` have a part in; gives the dates whose minutes were made again."""
    seen = _observed(tables, ts)
    columns = [c for c in seen.columns if c != ts]
    low, high = _start(first), _start(last + timedelta(days=1))
    before, after, ends = _around(seen, columns, ts, low, high)
    days = (min([*before, low]).date(), (max([*after, high]) if len(after) == len(columns) else max(ends[1], high)).date())
    days = (max(min(days[0], first), min(ends[0].date(), first)), days[1] + timedelta(days=1))  # a day for what looks back
    # observations that the first and the last of these minutes rest on
    reach = timedelta(minutes=REACH + 1)
    before, after, _ = _around(seen, columns, ts, _start(days[0]) - reach, _start(days[1] + timedelta(days=1)))
    start = min(before, default=ends[0])
    stop = max(after) if len(after) == len(columns) else ends[1]
    near = [t.where(col(ts).between(F.lit(start), F.lit(stop + timedelta(seconds=1)))) for t in tables]
    minutes = dosing.enrich(minute_table(near, ts), ts)
    write_minutes(minutes, f"{path}/minute", ts, only=days)
    _summaries(tables[0].sparkSession, path, ts, days)
    return days


def _start(day: date) -> datetime:
    return datetime.combine(day, time())


def _observed(tables: Sequence[DataFrame], ts: str) -> DataFrame:
    """The logs as the build takes them: a value is there or NULL."""
    merged = clean_names(outer_merge(tables, ts))
    values = [n for n in merged.columns if n != ts]
    binary = nm.binary_names(values, plant.BINARY_SUFFIX, plant.BINARY_NAMES)
    continuous = [n for n in values if n not in binary]
    return coerce(merged, continuous, binary).select(ts, *[col(n) for n in continuous])


def _around(seen: DataFrame, columns: Sequence[str], ts: str, low: datetime, high: datetime) -> tuple[list, list, tuple]:
    """Last observations below ``low``, first ones from ``high`` on, of the columns that have them; first and last time."""
    at = col(ts).cast("timestamp")
    row = seen.agg(
        F.min(at).alias("lo"),
        F.max(at).alias("hi"),
        *[F.max(F.when(col(c).isNotNull() & (at < F.lit(low)), at)).alias(f"b{i}") for i, c in enumerate(columns)],
        *[F.min(F.when(col(c).isNotNull() & (at >= F.lit(high)), at)).alias(f"a{i}") for i, c in enumerate(columns)],
    ).first()
    found = [[t for i in range(len(columns)) if (t := row[f"{side}{i}"]) is not None] for side in "ba"]
    return *found, (row.lo, row.hi)


def _summaries(spark: SparkSession, path: str, ts: str, days: tuple[date, date] | None) -> None:
    """Hours and days from the stored minutes (of the replaced dates and their neighbours); the small tables whole."""
    minute = read_parquet(spark, f"{path}/minute", ts)
    near, hours = minute, None
    if days is not None:
        hours = (days[0], days[1] + timedelta(days=1))  # the last minutes of a day belong to the next one's first hour
        near = minute.where(F.col("date").between(F.lit(days[0] - timedelta(days=1)), F.lit(hours[1])))
    plain = near.drop("date")
    hourly = rollup.plant_hourly(plain, ts)
    write_dates(hourly.withColumn("date", F.to_date(col(ts))), f"{path}/hourly", [ts], only=hours)
    write_dates(rollup.plant_daily(plain, ts).withColumn("date", F.col("day")), f"{path}/daily", ["day"], only=days)
    daily = read_parquet(spark, f"{path}/daily").drop("date")
    write_small(rollup.month_summary(daily), f"{path}/monthly")
    write_small(rollup.weekday_summary(daily), f"{path}/weekday")
    whole = minute.drop("date")
    if nm.present(whole, plant.STATES.values()):
        write_small(events.transitions(whole, ts), f"{path}/events")
        write_csv(events.metrics_table(whole, ts), f"{path}/event_metrics")
