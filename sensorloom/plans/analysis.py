"""Interactive analysis: one object over the frame set, every view a lazy DataFrame.

Over a folder that the build job wrote, a window reads its own dates only: minutes are stored enriched and events are
stored, so the clip reaches the scans of both.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import dosing, events, features, report, rollup
from sensorloom.operators.clean import clip_time, window_bounds
from sensorloom.sources.tables import FrameSet, load_frames

SIDE_TABLES = {"Struvite Observations": "struvite", "Chemistry Lab Results": "labs"}


class Analysis:
    """Views over a frame set; ``window`` gives a new object over a part of the record."""

    def __init__(self, frames: FrameSet, ts: str = "ts", found: DataFrame | None = None):
        self.frames, self.ts = frames, ts
        self._found = found if found is not None else frames.events

    @classmethod
    def open(cls, spark: SparkSession, folder: str, ts: str = "ts") -> Analysis:
        frames = load_frames(
            spark,
            folder,
            enrich=lambda m: dosing.enrich(m, ts),
            hourly_from_minute=lambda m: rollup.plant_hourly(m, ts),
            ts=ts,
            side_tables=SIDE_TABLES,
        )
        return cls(frames, ts)

    def events(self) -> DataFrame:
        return self._found if self._found is not None else events.transitions(self.frames.minute, self.ts)

    def window(self, mode: str = "full", start=None, end=None) -> Analysis:
        """Clip all frames and the event table; period summaries and metrics follow the clipped rows."""
        lo, hi = window_bounds(self._ends(), self.ts, mode, start, end).first()
        return self.between(lo, hi)

    def _ends(self) -> DataFrame:
        """Rows that hold the first and the last time: where dates are folders, those of the first and the last date."""
        minute = self.frames.minute
        if "date" not in minute.columns:
            return minute
        first, last = minute.agg(F.min("date"), F.max("date")).first()  # file metadata only
        return minute.where(F.col("date").isin(first, last)) if first is not None else minute

    def between(self, lo, hi) -> Analysis:
        f = self.frames

        def clip(df, name):
            if df is None:
                return None
            return clip_time(df, name, lo, hi, date_column="date" if "date" in df.columns else None)

        daily = clip(f.daily, "day")
        new = replace(
            f,
            minute=clip(f.minute, self.ts),
            hourly=clip(f.hourly, self.ts),
            daily=daily,
            monthly=rollup.month_summary(daily) if daily is not None else f.monthly,
            weekday=rollup.weekday_summary(daily) if daily is not None else f.weekday,
            event_metrics=None if f.minute is not None else f.event_metrics,
            events=None,
        )
        return Analysis(new, self.ts, clip(self.events(), self.ts) if f.minute is not None else clip(f.events, self.ts))

    def event_metrics(self) -> DataFrame:
        if self.frames.event_metrics is not None:
            return self.frames.event_metrics
        return events.metrics_table(self.frames.minute, self.ts)

    def event_study(self, chemical: str, event_type: str, signal: str) -> DataFrame:
        kind = (F.col("chemical") == chemical) & (F.col("event_type") == event_type)
        found = events.transitions(self.frames.minute, self.ts).where(kind)
        return events.study_summary(events.aligned_signal(self.frames.minute, self.ts, found, signal))

    def anomalies(self, signal: str, threshold: float = 3.0, window: int = 1440) -> DataFrame:
        return features.anomalies(self.frames.minute, self.ts, signal, threshold=threshold, window=window)

    def summary(self) -> DataFrame:
        return report.window_summary(self.frames.minute, self.ts, self.events())

    def status(self) -> DataFrame:
        f = self.frames
        tables = {"minute": f.minute, "hourly": f.hourly, "daily": f.daily, "monthly": f.monthly, "weekday": f.weekday}
        return report.dataset_status(tables)
