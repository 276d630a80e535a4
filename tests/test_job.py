"""The build job: what it writes is what the analysis reads; a rebuild equals a full build."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from helpers import frame, pandas_of, same

from sensorloom import plant
from sensorloom.plans.analysis import Analysis
from sensorloom.plans.job import build_all, rebuild

PARTS = ["minute", "hourly", "daily", "monthly", "weekday", "events"]
KEYS = {"minute": ["ts"], "hourly": ["ts"], "daily": ["day"], "monthly": ["month"], "weekday": ["weekday"], "events": ["ts", "chemical"]}


def logs(changed=False):
    t = pd.date_range("2025-09-10", periods=6 * 1440, freq="1min")
    rng = np.random.default_rng(9)
    gas = pd.DataFrame({"ts": t, plant.RAW_NH3: rng.uniform(1, 9, len(t)).round(2)})
    gas.loc[rng.random(len(t)) < 0.3, plant.RAW_NH3] = np.nan
    h2s = pd.DataFrame({"ts": t[::2], plant.RAW_H2S: rng.uniform(0, 2, len(t) // 2).round(2)})
    water = pd.DataFrame({"ts": t[::700], plant.WEST: np.arange(len(t[::700]), dtype=float), plant.EAST: 3.0})
    if changed:  # one day: other values, a hole, a later start
        day = (gas["ts"] >= "2025-09-12") & (gas["ts"] < "2025-09-13")
        gas.loc[day, plant.RAW_NH3] += 5
        gas = gas[~(gas["ts"].between("2025-09-12 20:00", "2025-09-12 23:50"))]
        water = water[~water["ts"].between("2025-09-12", "2025-09-12 23:59")]
    return gas, h2s, water


def tables(spark, changed=False):
    return [frame(spark, x) for x in logs(changed)]


def stored(spark, path, name):
    df = spark.read.parquet(f"{path}/{name}")
    return pandas_of(df, KEYS[name])


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    once, again = (str(tmp_path_factory.mktemp(n)) for n in ("whole", "again"))
    build_all(tables(spark), again)
    days = rebuild(tables(spark, changed=True), again, date(2025, 9, 12), date(2025, 9, 12))
    build_all(tables(spark, changed=True), once)
    return once, again, days


def test_rebuild_equals_a_full_build(spark, folders):
    once, again, days = folders
    assert days[0] >= date(2025, 9, 10) and days[1] <= date(2025, 9, 15) and days != (date(2025, 9, 10), date(2025, 9, 15))
    for name in PARTS:
        a, b = stored(spark, once, name), stored(spark, again, name)
        assert list(a.columns) == list(b.columns) and len(a) == len(b), name
        for c in a.columns:
            if a[c].dtype.kind in "fi":
                same(a[c], b[c], 1e-9)
            else:
                assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), (name, c)


def test_only_some_dates_are_written_anew(spark, folders):
    _, again, days = folders
    files = spark.read.parquet(f"{again}/minute").selectExpr("date", "_metadata.file_modification_time AS t").distinct().collect()
    newest = {}
    for r in files:
        newest[r.date] = max(newest.get(r.date, r.t), r.t)
    inside = [t for d, t in newest.items() if days[0] <= d <= days[1]]
    outside = [t for d, t in newest.items() if not days[0] <= d <= days[1]]
    assert outside and max(outside) < min(inside)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_window_reads_its_own_dates(spark, folders):
    whole = Analysis.open(spark, folders[0])
    part = whole.window("custom", "2025-09-12", "2025-09-13")
    for df in (part.frames.minute, part.frames.hourly):
        plan = plan_of(df)
        filters = plan[plan.index("PartitionFilters") :]
        assert "date" in filters[: filters.index("PushedFilters")] and "GreaterThanOrEqual(ts" in filters
        assert "Window" not in plan and "Exchange" not in plan
    assert "GreaterThanOrEqual(ts" in plan_of(part.events())
    got = pandas_of(part.frames.minute, ["ts"])
    full = pandas_of(whole.frames.minute, ["ts"])
    want = full[(full["ts"] >= "2025-09-12") & (full["ts"] < "2025-09-14")].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)  # flows are filled from before the window
    assert len(got) == 2880 and got[plant.WEST].notna().all()
    ends = plan_of(whole._ends())
    assert "PartitionFilters: [date" in ends
    assert part.summary().count() == 1 and part.event_metrics().count() >= 0
