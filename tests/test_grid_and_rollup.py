import numpy as np
import pandas as pd
from helpers import frame, minutes, pandas_of, same
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sensorloom import plant
from sensorloom.functions.timekit import from_local, to_local
from sensorloom.operators import dosing, grid, rollup
from sensorloom.operators.clean import clip_time


def series(values):
    return pd.DataFrame({"ts": minutes(len(values)), "v": np.asarray(values, dtype=float)})


def fill(spark, values, limit, **kw):
    return pandas_of(grid.fill_gaps(frame(spark, series(values)), "ts", ["v"], limit=limit, **kw), ["ts"])["v"].to_numpy()


N = np.nan


def test_partial_fill_and_trailing_carry(spark):
    same(fill(spark, [N, 1, N, N, N, 5, N, N, N, N], 2), [N, 1, 2, 3, N, 5, 5, 5, N, N])


def test_gap_of_ten_and_eleven(spark):
    values = [1.0, *[N] * 10, 12.0, *[N] * 11, 24.0, *[N] * 12]
    got = fill(spark, values, 10)
    same(got[:12], np.arange(1.0, 13.0))
    same(got[12:24], [*np.arange(13.0, 23.0), N, 24.0])
    same(got[24:], [24.0] * 10 + [N, N])


def test_hold_equals_fill_then_carry(spark):
    values = [N, 1.0, *[N] * 14, 16.0, *[N] * 12]
    want = pd.Series(fill(spark, values, 10)).ffill()
    same(fill(spark, values, 10, hold=["v"]), want)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=1, max_size=60), st.integers(1, 5))
def test_fill_equals_pandas(spark, values, limit):
    s = series([N if v is None else float(v) for v in values])
    want = s.set_index("ts")["v"].interpolate(method="time", limit=limit)
    same(fill(spark, s["v"], limit, span=7), want)


def test_grid_bins_and_flags(spark):
    pdf = pd.DataFrame(
        {"ts": pd.to_datetime(["2026-01-01 23:58:10", "2026-01-01 23:58:50", "2026-01-02 00:02:00"]), "v": ["1", "3", "bad"],
         "on": [0, 1, 0]}
    )
    df = grid.mark_missing(grid.minute_grid(frame(spark, pdf), "ts", means=["v"], maxima=["on"]), ["v"])
    got = pandas_of(df, ["ts"])
    assert got["ts"].astype(str).str[11:16].tolist() == ["23:58", "23:59", "00:00", "00:01", "00:02"]
    same(got["v"], [2, N, N, N, N])
    assert got["interp_flag"].tolist() == [0, 1, 1, 1, 1]
    same(got["on"], [1, N, N, N, 0])


def gappy(seed):
    """Two series of several days with gaps of minutes and of days, rows without a value, an unfilled column."""
    rng, parts = np.random.default_rng(seed), []
    for k in ("a", "b"):
        t = np.concatenate([np.arange(700, 1500), np.arange(1500, 1600, 13), np.arange(6100, 6400), [9000, 9001]])
        t = t[rng.random(len(t)) > 0.3] * 60 + 17
        v = np.where(rng.random(len(t)) < 0.3, np.nan, rng.normal(5, 2, len(t)))
        parts.append(pd.DataFrame({"k": k, "ts": pd.Timestamp("2026-01-01") + pd.to_timedelta(t, "s"), "v": v, "w": v * 2 + 1, "on": rng.integers(0, 2, len(t))}))
    return pd.concat(parts)


def test_one_layout_equals_pandas(spark):
    pdf = gappy(3)
    got = grid.filled_minutes(
        frame(spark, pdf), "ts", means=["v", "w"], maxima=["on"], keys=["k"], fill=["v"], limit=10, carried={"w": -1.0}, flag="gap"
    )
    assert got.columns == ["k", "ts", "v", "w", "on", "gap"]
    got = pandas_of(got, ["k", "ts"])
    for k, part in pdf.groupby("k"):
        part = part.assign(ts=part["ts"].dt.floor("min")).groupby("ts").agg({"v": "mean", "w": "mean", "on": "max"}).asfreq("1min")
        mine = got[got["k"] == k]
        assert mine["ts"].tolist() == part.index.tolist()
        same(mine["v"], part["v"].interpolate(method="time", limit=10))
        same(mine["w"], part["w"].ffill().fillna(-1.0))
        same(mine["on"], part["on"])
        assert mine["gap"].tolist() == part["v"].isna().astype(int).tolist()


def test_one_layout_without_keys_and_rows(spark):
    pdf = gappy(4).query("k == 'a'")[["ts", "v"]]
    got = grid.filled_minutes(frame(spark, pdf), "ts", means=["v"], minutes=60, fill=["v"], limit=90, hold=["v"])
    want = pdf.assign(ts=pdf["ts"].dt.floor("h")).groupby("ts")["v"].mean().asfreq("1h")
    steps = pandas_of(grid.fill_gaps(frame(spark, want.reset_index()), "ts", ["v"], limit=90, hold=["v"]), ["ts"])
    got = pandas_of(got, ["ts"])
    assert got["ts"].tolist() == want.index.tolist()
    same(got["v"], steps["v"])
    assert grid.filled_minutes(frame(spark, pdf).limit(0), "ts", means=["v"], fill=["v"], limit=5).count() == 0


def test_one_layout_reads_its_log_once(spark, tmp_path):
    frame(spark, gappy(5)).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    df = grid.filled_minutes(log, "ts", means=["v", "w"], maxima=["on"], keys=["k"], fill=["v", "w"], limit=10)
    df.collect()
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 6  # two of them a repeat


def test_nan_counts_as_missing(spark):
    df = spark.sql("SELECT timestamp'2026-01-01 00:00' AS ts, double('NaN') AS v UNION ALL SELECT timestamp'2026-01-01 00:00', 4D")
    assert grid.minute_grid(df, "ts", means=["v"]).first()["v"] == 4.0


def test_empty_hour_sums_to_zero(spark):
    pdf = pd.DataFrame({"ts": pd.to_datetime(["2026-01-01 00:00", "2026-01-01 02:30"]), "v": [1.0, 2.0]})
    got = pandas_of(rollup.hour_ending(frame(spark, pdf), "ts", sums={"s": "v"}, means={"m": "v"}), ["ts"])
    same(got["s"], [1, 0, 0, 2])
    same(got["m"], [1, N, N, 2])


def f4(**extra):
    return pd.DataFrame(
        {
            "ts": minutes(4, freq="30min"), plant.WEST: [10.0, 10, 20, 20], plant.EAST: [1.0, 1, 2, 2],
            plant.DIGESTER: [0.0, 0, 3, 3], plant.NH3: [4.0, 6, 10, 12], plant.H2S: [1.0, 3, 2, 5], **extra,
        }
    )


def test_hour_ending_plant_table(spark):
    got = pandas_of(rollup.plant_hourly(dosing.loads(frame(spark, f4()), "ts"), "ts"), ["ts"])
    assert got["ts"].dt.hour.tolist() == [0, 1, 2]
    same(got[plant.NH3], [4.0, 8.0, 12.0])
    same(got[plant.H2S], [1.0, 3.0, 5.0])
    same(got["flow_gal_hr"], [11, 36, 25])
    same(got["lbs_volatile"], np.array([11, 36, 25]) * plant.LBS_PER_GAL)
    same(got["fecl3_lbs"], np.array([11, 36, 25]) * plant.LBS_PER_GAL / 24.3)


def two_days():
    n = 2880
    first = np.arange(n) < 1440
    return pd.DataFrame(
        {
            "ts": minutes(n), plant.NH3: np.where(first, 10.0, 20.0), plant.H2S: np.where(first, 1.0, 3.0),
            plant.WEST: 10.0, plant.EAST: 1.0, plant.DIGESTER: 0.0, "ferric_available": 1, "hcl_available": 0,
            "interp_flag": 0, "ferric_solution_lbs_per_day": 583.0, "ferric_active_lbs_per_day": 220.0,
            "hcl_solution_lbs_per_day": 0.0, "hcl_active_lbs_per_day": 0.0,
        }
    )


def test_two_day_build(spark):
    daily = rollup.plant_daily(frame(spark, two_days()), "ts").cache()
    got = pandas_of(daily, ["day"])
    same(got[plant.NH3], [10, 20])
    same(got[plant.H2S], [1, 3])
    same(got["nh3_coverage"], [1, 1])
    same(got["transferred_lbs_vol_daily"], [11 * 1440 * plant.LBS_PER_GAL] * 2)
    month = rollup.month_summary(daily).first()
    assert (month["month"], month["nh3_monthly_mean"], month["days_in_data"]) == (1, 15.0, 2)
    week = pandas_of(rollup.weekday_summary(daily), ["weekday"])
    assert week["weekday_name"].tolist() == ["Thursday", "Friday"]
    assert week["days_in_data"].tolist() == [1, 1]


def test_period_summaries(spark):
    pdf = pd.DataFrame(
        {
            "day": [d.date() for d in pd.to_datetime(["2026-01-05", "2026-01-06", "2026-02-02", "2026-02-03"])],
            plant.NH3: [10.0, 14, 20, 24], plant.H2S: [1.0, 3, 5, 7], "total_gpm": [1.0, 2, 3, 4],
            "transferred_lbs_vol_daily": [1.0, 2, 3, 4],
        }
    )
    df = frame(spark, pdf)
    month = pandas_of(rollup.month_summary(df), ["month"])
    assert month["nh3_monthly_mean"].tolist() == [12.0, 22.0]
    assert month["h2s_monthly_mean"].tolist() == [2.0, 6.0]
    assert month["days_in_data"].tolist() == [2, 2]
    assert pandas_of(rollup.weekday_summary(df), ["weekday"])["weekday_name"].tolist() == ["Monday", "Tuesday"]


def test_days_without_observations_are_dropped(spark):
    pdf = pd.DataFrame({"ts": minutes(3, freq="1D"), plant.NH3: [1.0, N, 2.0], plant.WEST: [N, N, 1.0]})
    got = pandas_of(rollup.plant_daily(frame(spark, pdf), "ts"), ["day"])
    assert [d.day for d in got["day"]] == [1, 3]


def test_closed_time_filter(spark):
    pdf = pd.DataFrame({"ts": minutes(6, freq="1h"), "value": range(6)})
    df = frame(spark, pdf)
    got = pandas_of(clip_time(df, "ts", "2026-01-01 01:00", "2026-01-01 03:00"), ["ts"])
    assert got["value"].tolist() == [1, 2, 3]


def test_dose_backfill_and_intensity(spark):
    pdf = f4().iloc[:3].assign(ts=minutes(3, "2025-10-02 14:30", "1h"), hcl_available=[1, 1, 0], ferric_available=[1, 1, 0])
    got = pandas_of(dosing.enrich(frame(spark, pdf), "ts"), ["ts"])
    same(got["hcl_active_lbs_per_day"], [6230 * 0.32] * 2 + [0])
    same(got["ferric_active_lbs_per_day"], [583 * 0.379] * 2 + [0])


def test_mg_per_litre(spark):
    from sensorloom.functions.numeric import dose_mgl_from_gpm

    df = spark.createDataFrame([(8.34, 694.4444444), (16.68, 694.4444444), (8.34, 0.0), (None, 694.0)], "lbs double, gpm double")
    got = [r[0] for r in df.select(dose_mgl_from_gpm("lbs", "gpm")).collect()]
    same(got[:2], [1.0, 2.0], 1e-6)
    assert got[2:] == [None, None]


def test_ferric_is_halved_from_the_cut(spark):
    pdf = pd.DataFrame({"ts": pd.to_datetime(["2026-01-06 23:59", "2026-01-07 00:00"]), "ferric_available": [1, 1]})
    got = pandas_of(dosing.ferric_dose(frame(spark, pdf), "ts"), ["ts"])
    same(got["ferric_solution_lbs_per_day"], [583, 291.5])
    none = dosing.ferric_dose(frame(spark, pdf[["ts"]]), "ts").first()
    assert none["ferric_active_lbs_per_day"] is None


def test_operating_calendar(spark):
    stamps = ["2025-08-26 23:59", "2025-08-27 00:00", "2025-10-02 14:30", "2025-11-06 00:00", "2026-01-07 12:00"]
    pdf = pd.DataFrame({"ts": pd.to_datetime(stamps)})
    got = pandas_of(dosing.operating_flags(frame(spark, pdf), "ts"), ["ts"])
    assert got["hcl_available"].tolist() == [1, 0, 1, 0, 0]
    assert got["sensor_valid"].tolist() == [1, 1, 1, 0, 0]
    assert got["ferric_reduced_rate"].tolist() == [0, 0, 0, 0, 1]
    assert got["truck_activity_proxy"].tolist() == [0, 0, 1, 0, 1]


def test_local_days_over_clock_changes(spark):
    pdf = pd.concat(
        [pd.DataFrame({"ts": minutes(96, start, "30min")}) for start in ("2025-11-01 12:00", "2026-03-07 12:00")], ignore_index=True
    )
    pdf["mean"] = pdf["peak"] = np.arange(len(pdf), dtype=float) ** 1.5
    wall = pdf.ts.dt.tz_localize("UTC").dt.tz_convert("US/Eastern")
    want = pdf.assign(local_date=wall.dt.date).groupby("local_date").agg(mean=("mean", "mean"), peak=("peak", "max"), n=("ts", "size"))
    assert {50, 46} <= set(want.n)  # a day of 25 hours and one of 23
    df = frame(spark, pdf)
    got = pandas_of(rollup.local_daily(df, "ts", means=["mean"], maxima=["peak"]), ["local_date"])
    assert got["local_date"].tolist() == want.index.tolist()
    same(got["mean"], want["mean"])
    same(got["peak"], want["peak"])
    shown = df.select("ts", to_local("ts").alias("wall")).toPandas().sort_values("ts")
    assert shown.wall.tolist() == wall.dt.tz_localize(None).tolist()


def test_wall_clock_to_instant_over_clock_changes(spark):
    sure = minutes(200, "2026-03-07 20:00", "7min").append(minutes(200, "2025-11-01 00:00", "7min"))
    sure = sure[(sure < "2026-03-08 02:00") | (sure >= "2026-03-08 03:00")]  # that hour was skipped
    want = sure.tz_localize("US/Eastern", ambiguous="raise").tz_convert("UTC").tz_localize(None)
    got = frame(spark, pd.DataFrame({"wall": sure})).select("wall", from_local("wall").alias("ts")).toPandas()
    assert sorted(got.ts) == sorted(want)
