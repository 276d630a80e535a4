"""Time expressions. All of them expect a session clock in UTC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.functions.names import col

# Fixed patterns of the plant export and of the gas logger, tried in this order.
TIME_PATTERNS = ["M/d/yy h:mm:ss a", "M-d-yyyy, h-mm-ss a"]


def as_time(c: str | Column) -> Column:
    return col(c).cast("timestamp")


def parse_time(c: str | Column, patterns: list[str] | None = None, general: bool = True) -> Column:
    """First pattern that parses wins; text that fits none becomes NULL.

    Two-digit years run from 1969 to 2068.
    """
    text = F.trim(col(c).cast("string"))
    tries = []
    for p in TIME_PATTERNS if patterns is None else patterns:
        # a failed parse is an exception inside the JVM, so texts of another shape skip it
        marks = [m for m in "/-,:" if m in p]
        fits = reduce(lambda a, b: a & b, [text.contains(m) for m in marks], F.lit(True))
        t = F.when(fits, F.try_to_timestamp(text, F.lit(p)))
        if "yyyy" not in p:
            t = F.when(F.year(t) >= 2069, t - F.expr("INTERVAL 100 YEARS")).otherwise(t)
        tries.append(t)
    if general:
        tries.append(F.try_to_timestamp(text))
    return F.coalesce(*tries)


def bin_start(ts: str | Column, minutes: int) -> Column:
    """Left-closed, left-labelled bin of a fixed width."""
    sec = F.unix_seconds(as_time(ts))
    return F.timestamp_seconds(sec - F.pmod(sec, F.lit(minutes * 60)))


def bin_end(ts: str | Column, minutes: int) -> Column:
    """Right-closed, right-labelled bin: ``(end - width, end]`` maps to ``end``."""
    width = minutes * 60_000_000
    micros = F.unix_micros(as_time(ts))
    over = F.pmod(micros, F.lit(width))
    return F.timestamp_micros(F.when(over == 0, micros).otherwise(micros - over + F.lit(width)))


def bucket_no(ts: str | Column, minutes: int) -> Column:
    """Number of the fixed-width time bucket that a row falls in."""
    return F.floor(F.unix_seconds(as_time(ts)) / F.lit(minutes * 60)).cast("long")


def second_in_bucket(ts: str | Column, minutes: int) -> Column:
    return F.pmod(F.unix_seconds(as_time(ts)), F.lit(minutes * 60))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Fractional minutes from ``start`` to ``end``."""
    return (F.unix_micros(as_time(end)) - F.unix_micros(as_time(start))) / F.lit(60_000_000.0)


def whole_minutes(start: str | Column, end: str | Column) -> Column:
    """Minutes from ``start`` to ``end``, truncated toward zero."""
    return minutes_between(start, end).cast("int")


def shift_minutes(ts: str | Column, minutes: int | Column) -> Column:
    step = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.timestamp_micros(F.unix_micros(as_time(ts)) + step.cast("long") * F.lit(60_000_000))


def to_local(ts: str | Column, zone: str = "US/Eastern") -> Column:
    """Wall-clock time of a UTC instant."""
    return F.from_utc_timestamp(as_time(ts), zone)


def from_local(ts: str | Column, zone: str = "US/Eastern") -> Column:
    """UTC instant of a wall-clock time."""
    return F.to_utc_timestamp(as_time(ts), zone)


def local_date(ts: str | Column, zone: str = "US/Eastern") -> Column:
    return F.to_date(to_local(ts, zone))


def monday_weekday(ts: str | Column) -> Column:
    """Weekday number with Monday = 0."""
    return F.weekday(as_time(ts))


def working_hours(ts: str | Column, first: int = 7, last: int = 18) -> Column:
    """1 on Monday to Friday inside the inclusive hour span, else 0."""
    return ((monday_weekday(ts) < 5) & F.hour(as_time(ts)).between(first, last)).cast("int")


def between_closed(ts: str | Column, start, end) -> Column:
    """Both ends inclusive; bounds may be text, datetime or Column."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return as_time(ts).between(lo.cast("timestamp"), hi.cast("timestamp"))
