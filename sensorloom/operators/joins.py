"""Joins on time: exact, as-of, and range joins around events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.names import col
from sensorloom.functions.timekit import as_time, bucket_no, minutes_between, shift_minutes
from sensorloom.operators.windows import DAY, carry


def outer_merge(tables: Sequence[DataFrame], ts: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Full outer merge on the time stamp with one shuffle.

    Each table has one row per stamp; a row without a time fails the job when it runs, so none is lost in silence.
    Equal value names keep the first table's column: rename the others before where they are wanted.
    """
    names: list[str] = []
    parts = []
    for t in tables:
        fresh = [n for n in t.columns if n not in names and n not in (*keys, ts)]
        names += fresh
        timed = F.when(col(ts).isNull(), F.raise_error(F.lit(f"a row has no {ts}"))).otherwise(col(ts)).alias(ts)
        parts.append(t.select(*[col(k) for k in keys], timed, *[col(n) for n in fresh]))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*[col(k) for k in keys], col(ts)).agg(
        *[F.first(col(n), ignorenulls=True).alias(n) for n in names]
    )


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Row union by name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_on_time(left: DataFrame, right: DataFrame, ts: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Full outer join of two tables of different grain, for example minutes with hour ends."""
    return left.join(right, [*keys, ts], "full_outer")


def add_daily(left: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left joins of daily tables. The planner broadcasts a side only below its size limit."""
    return reduce(lambda a, b: a.join(b, list(on), "left"), others, left)


def last_event_before(
    df: DataFrame,
    ts: str,
    events: DataFrame,
    event_ts: str = "ts",
    *,
    keys: Sequence[str] = (),
    name: str = "event_ts",
    span: int = DAY,
) -> DataFrame:
    """As-of join, inclusive: the latest event at or before each distinct time of ``df``.

    Only distinct times take part in the ordered step; the rows get the answer
    through an equi-join, which AQE may split when one stamp is crowded.
    """
    at = as_time(ts)
    stamps = df.select(*[col(k) for k in keys], at.alias("__t")).distinct()
    marks = events.select(*[col(k) for k in keys], as_time(event_ts).alias("__t")).distinct()
    line = (
        stamps.withColumn("__ask", F.lit(1))
        .unionByName(marks.withColumn("__mark", F.lit(1)), allowMissingColumns=True)
        .groupBy(*[col(k) for k in keys], "__t")
        .agg(F.max("__ask").alias("__ask"), F.max("__mark").alias("__mark"))
    )
    answered = carry(
        line, "__t", last={name: F.when(F.col("__mark") == 1, F.col("__t"))}, keys=keys, span=span
    ).where("__ask = 1")
    return (
        df.withColumn("__t", at)
        .join(answered.select(*[col(k) for k in keys], "__t", name), [*keys, "__t"], "left")
        .drop("__t")
    )


def around_events(
    df: DataFrame,
    ts: str,
    events: DataFrame,
    event_ts: str,
    before: int,
    after: int,
    *,
    keys: Sequence[str] = (),
    span: int = DAY,
    relative: str = "rel",
) -> DataFrame:
    """Rows within ``[-before, +after]`` minutes of each event, both ends inclusive.

    An event is copied to the time buckets that its window covers (a fixed
    number), then an equi-join on key and bucket meets the rows. ``relative`` holds
    fractional minutes from the event.
    """
    at = as_time(event_ts)
    lo, hi = shift_minutes(at, -before), shift_minutes(at, after)
    spread = (
        events.where(at.isNotNull())
        .withColumn("__lo", lo)
        .withColumn("__hi", hi)
        .withColumn("__bucket", F.explode(F.sequence(bucket_no("__lo", span), bucket_no("__hi", span))))
    )
    rows = df.withColumn("__t", as_time(ts)).withColumn("__bucket", bucket_no(ts, span))
    hits = rows.join(spread, [*keys, "__bucket"]).where(F.col("__t").between(F.col("__lo"), F.col("__hi")))
    return hits.withColumn(relative, minutes_between(event_ts, "__t")).drop("__bucket", "__lo", "__hi", "__t")


def to_long(df: DataFrame, ids: Sequence[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Wide to long as doubles; ``columns`` maps label to column name."""
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias("k"), col(c).cast("double").alias("v"))
            for label, c in columns.items()
        ]
    )
    return df.select(*[col(i) for i in ids], F.explode(pairs).alias("__p")).select(
        *[col(i) for i in ids], F.col("__p.k").alias(name), F.col("__p.v").alias(value)
    )


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, labels: Sequence[str]
) -> DataFrame:
    """Long to wide for a known list of labels: one aggregate, no scan for the labels."""
    picks: list[Column] = [F.max(F.when(col(name) == x, col(value))).alias(x) for x in labels]
    return df.groupBy(*[col(i) for i in ids]).agg(*picks)
