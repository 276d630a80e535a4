import math

import numpy as np
import pandas as pd
import pytest
from helpers import frame, minutes, noisy_series, pandas_of, same
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.numeric import error_metrics, limit_metrics, pearson
from sensorloom.operators import dosing, features, model, stats
from sensorloom.operators.joins import last_event_before, outer_merge
from sensorloom.plans.build import minute_table, modeling_metadata, modeling_table


def reference_z(s, window):
    mp = max(10, window // 10)
    mean = s.rolling(window, min_periods=mp).mean()
    sd = pd.Series([s.iloc[max(0, i - window + 1) : i + 1].std() for i in range(len(s))], index=s.index)
    sd[s.rolling(window, min_periods=0).count() < mp] = np.nan
    return (s - mean) / sd.replace(0, np.nan)


def test_z_scores(spark):
    pdf = noisy_series(3000, 7)
    got = pandas_of(features.zscore(frame(spark, pdf), "ts", "v", 240), ["ts"])
    same(got["z_score"], reference_z(pdf["v"], 240), 1e-8)
    found = features.by_severity(features.anomalies(frame(spark, pdf), "ts", "v", threshold=2.5, window=240), "ts").toPandas()
    z = reference_z(pdf["v"], 240)
    same(found["z_score"].abs(), np.sort(z.abs()[z.abs() >= 2.5].to_numpy())[::-1], 1e-8)


def test_constant_series_has_no_z_score(spark):
    got = features.zscore(frame(spark, pd.DataFrame({"ts": minutes(300), "v": 0.1})), "ts", "v", 60)
    assert got.where("z_score IS NOT NULL").count() == 0


def test_missing_target_exceeds_nothing(spark):
    pdf = pd.DataFrame({"ts": minutes(20), plant.NH3: [6.0] * 20, plant.H2S: [0.5] * 20})
    got = pandas_of(features.future_targets(frame(spark, pdf), "ts"), ["ts"])
    flags = got["nh3_exceeds_5.0_ppm_t_plus_15min"].tolist()
    assert flags == [1] * 5 + [0] * 15
    assert got[f"{plant.RAW_NH3}_t_plus_15min"].isna().all()


def site(n=5000, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"ts": minutes(n, "2025-09-30 05:00")})
    pdf[plant.NH3] = np.where(rng.random(n) < 0.1, np.nan, 5 + np.sin(np.arange(n) / 200) + rng.normal(0, 0.2, n))
    pdf[plant.H2S] = np.where(rng.random(n) < 0.1, np.nan, rng.exponential(1, n))
    for c in plant.FLOWS:
        pdf[c] = np.where(rng.random(n) < 0.3, np.nan, rng.uniform(50, 90, n))
    pdf["ferric_available"] = (np.arange(n) // 700 % 2).astype(int)
    pdf["hcl_available"] = (np.arange(n) // 900 % 2 == 0).astype(int)
    pdf["sensor_valid"] = 1
    return pdf


def test_modeling_table_against_single_operators(spark):
    df = frame(spark, site()).cache()
    fused = pandas_of(modeling_table(df, "ts"), ["ts"])
    step = dosing.loads(df, "ts")
    step = features.minutes_since_changes(step, "ts")
    step = features.interactions(features.calendar(step, "ts"))
    step = pandas_of(features.quality_flags(features.future_targets(step, "ts")), ["ts"])
    for c in step.columns:
        if c != "ts":
            same(fused[c], step[c], 1e-9)
    assert fused["split"].value_counts().to_dict() == {"train": 3500, "validation": 750, "test": 750}


def test_state_timing_against_pandas(spark):
    pdf = site(2000)
    got = pandas_of(features.minutes_since_changes(frame(spark, pdf), "ts"), ["ts"])
    s = pdf["hcl_available"]
    i = pd.Series(np.arange(len(s), dtype=float))
    for kind, marks in {"on": s.diff() == 1, "off": s.diff() == -1, "state_change": s.ne(s.shift())}.items():
        same(got[f"minutes_since_hcl_{kind}"], i - i.where(marks).ffill())


def test_metadata(spark):
    table = modeling_table(frame(spark, site()), "ts")
    row = modeling_metadata(table, "ts").first()
    assert (row["n_rows"], row["n_columns"]) == (5000, len(table.columns))
    assert row["split_counts"]["train"] == 3500


def test_master_build(spark):
    n = 600
    t = pd.date_range("2025-09-12 00:00:20", periods=n, freq="1min")
    rng = np.random.default_rng(2)
    gas = pd.DataFrame({"ts": t, "nh3_nh3_ppm": rng.uniform(1, 9, n).round(2).astype(str), "nh3_iso_time": "x"})
    gas.loc[100:130, "nh3_nh3_ppm"] = "No Data"
    h2s = pd.DataFrame({"ts": t, "h2s_h2s_ppm": rng.uniform(0, 2, n).round(2).astype(str)})
    water = pd.DataFrame({"ts": t[::20], "eest_sludge_out_gpm": 7.0, plant.WEST: np.arange(30.0)})
    got = pandas_of(minute_table([frame(spark, x) for x in (h2s, gas, water)], "ts"), ["ts"])
    assert len(got) == n - 60 and "nh3_iso_time" not in got.columns and "eest_sludge_out_gpm" not in got.columns
    raw = pd.to_numeric(gas["nh3_nh3_ppm"], errors="coerce")
    filled = raw.interpolate(limit=10)
    same(got["nh3_nh3_ppm"], filled[60:])
    same(got["nh3_lag_60min"], filled.shift(60)[60:])
    same(got[plant.NH3], filled.rolling(15, min_periods=1).mean()[60:])
    west = pd.Series(np.nan, index=range(n))
    west[::20] = np.arange(30.0)
    same(got[plant.WEST], west.interpolate(limit=10).ffill()[60:])
    same(got[plant.COMBINED], [7.0] * (n - 60))
    assert got["interp_flag"].sum() > 0 and (got["ferric_solution_lbs_per_day"].isin([0, 583])).all()


def test_features_leak_nothing_and_training_runs(spark):
    table = modeling_table(frame(spark, site(3000)), "ts").cache()
    chosen = model.feature_columns(table)
    assert chosen == sorted(chosen) and "split" not in chosen and plant.NH3 in chosen
    assert not any("_t_plus_" in c or "_delta_" in c or "model_row_valid" in c for c in chosen)
    fitted, predictions = model.train_target(
        table, "ts", target=f"{plant.NH3}_t_plus_60min", current=plant.NH3, valid="model_row_valid_60min", name="nh3",
        features=chosen, rounds=3, depth=3,
    )
    got = predictions.toPandas()
    assert set(got["split"]) == {"train", "validation", "test"} and got["y_pred_model"].notna().all()
    train = got[got["split"] == "train"]
    now = pandas_of(table, ["ts"]).set_index("ts")[plant.NH3]
    want = got["timestamp"].map(now).fillna(train["y_true"].median())
    same(got["y_pred_persistence"], want)
    metrics = model.evaluate(predictions, limit=5.0).toPandas()
    assert len(metrics) == 6 and metrics["mae"].gt(0).all()


def test_boosted_queries_use_the_defaults_and_valid_rows(monkeypatch):
    from sensorloom.catalog import modeling

    seen = {}
    monkeypatch.setattr(modeling, "site_minutes", lambda spark, d: None)
    monkeypatch.setattr(modeling, "modeling_table", lambda df, ts: None)
    monkeypatch.setattr(modeling, "fill_gaps", lambda df, *given, **named: None)
    monkeypatch.setattr(modeling.model, "train_target", lambda df, ts, **given: seen.update(given))
    modeling._boosted(None, "")
    assert seen["valid"] == "model_row_valid_60min" and seen.keys().isdisjoint(plant.BOOSTING)
    assert (plant.BOOSTING["rounds"], plant.BOOSTING["depth"], plant.BOOSTING["l2"]) == (300, 6, 0.1)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    row = df.agg(*[c.alias(n) for n, c in {**error_metrics("y", "p"), **limit_metrics("y", "p", 4.5)}.items()]).first()
    same([row["mae"], row["rmse"], row["r2"]], [2 / 3, math.sqrt(2 / 3), 1 - 2 / 8])
    assert (row["accuracy"], row["precision"], row["recall"]) == (pytest.approx(2 / 3), None, 0.0)


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0), (2.0, 4.0, 2.0, 1.0), (3.0, 6.0, 1.0, 1.0)], "a double, b double, c double, k double")
    m = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    assert len(m) == 16
    same([m["a", "b"], m["a", "c"], m["b", "b"]], [1, -1, 1])
    assert m["a", "k"] is None and m["k", "k"] is None
    pdf = pd.DataFrame(np.random.default_rng(1).normal(size=(200, 2)), columns=["x", "y"])
    pdf.loc[::7, "x"], pdf.loc[::5, "y"] = np.nan, np.nan
    r = frame(spark, pdf).agg(pearson("x", "y")).first()[0]
    same([r], [pdf["x"].corr(pdf["y"])])
    assert stats.correlation_matrix(df.limit(0), ["a", "b"]).count() == 4


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(700, 60)) * rng.uniform(0.1, 1e6, 60) + rng.uniform(-1e6, 1e6, 60), columns=[f"c{i}" for i in range(60)])
    pdf["c1"] = pdf["c0"] * 2 + rng.normal(size=700)
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    pdf["c7"] = 0.1
    df = frame(spark, pdf).repartition(6)
    out = stats.correlation_matrix(df, list(pdf.columns))
    plan = out._jdf.queryExecution().executedPlan().toString()
    m = {(r["a"], r["b"]): r["r"] for r in out.collect()}
    want = pdf.corr()
    assert len(m) == 3600
    for a in pdf.columns:
        for b in pdf.columns:
            assert m[a, b] is None if "c7" in (a, b) else abs(m[a, b] - want.loc[a, b]) < 1e-9
    assert plan.count("Generate") <= 2 and plan.count("Exchange hashpartitioning") == 1


def test_trend(spark):
    row = stats.linear_trend(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, 8.0), (5.0, None)], "x double, y double"), "x", "y").first()
    same([row["slope"], row["intercept"], row["r2"], row["n"]], [2, 0, 1, 4])
    flat = stats.linear_trend(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()
    assert flat["slope"] is None


def test_welch(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v) for v in (2.0, 6.0, 7.0)] + [("c", 1.0)]
    got = stats.welch_tests(spark.createDataFrame(rows, "p string, v double"), "p", ["v"], order=["a", "b", "c"]).collect()
    assert len(got) == 1
    va, vb = np.var([1, 2, 3, 4], ddof=1) / 4, np.var([2, 6, 7], ddof=1) / 3
    same([got[0]["t"], got[0]["df"]], [(2.5 - 5) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / 3 + vb**2 / 2)])
    assert 0.05 < got[0]["p"] < 0.5 and not got[0]["significant"]


def p_of(spark, rows):
    df = spark.createDataFrame(rows, "t double, df double")
    return [r.p for r in df.coalesce(1).select(stats.student_p(F.col("t"), F.col("df")).alias("p")).collect()]


def test_student_p_against_printed_table(spark):
    # two-sided 5 % points of Student's t
    table = [(12.706, 1.0), (2.571, 5.0), (2.228, 10.0), (2.042, 30.0), (1.980, 120.0)]
    same(p_of(spark, table), [0.05] * 5, 4e-4)
    assert p_of(spark, [(0.0, 7.0), (math.inf, 7.0), (None, 7.0), (1.0, None)]) == [1.0, 0.0, None, None]


def test_student_p_against_closed_forms(spark):
    ts = [-40.0, 1e-6, 0.3, 1.0, 1.7, 1.75, 2.0, 5.0, 30.0]
    same(p_of(spark, [(t, 1.0) for t in ts]), [1 - 2 / math.pi * math.atan(abs(t)) for t in ts], 1e-10)
    same(p_of(spark, [(t, 2.0) for t in ts]), [1 - abs(t) / math.sqrt(2 + t * t) for t in ts], 1e-10)
    # at many degrees of freedom the normal distribution, up to a share of 1 / df
    for df in (1e10, 1e13):
        got, want = p_of(spark, [(t, df) for t in ts[1:-1]]), [math.erfc(abs(t) / math.sqrt(2)) for t in ts[1:-1]]
        np.testing.assert_allclose(got, want, rtol=1e-7)


def test_axis_and_histogram(spark):
    v = [1.0, 1.1, 1.2, 1.3, 1.4] * 20 + [50.0]
    row = stats.axis_range(frame(spark, pd.DataFrame({"v": v})), "v").first()
    assert row["range_high"] < 50 and row["log_allowed"]
    lo, hi = np.quantile(v, [0.02, 0.98])
    same([row["range_low"], row["range_high"]], [lo - 0.08 * (hi - lo), hi + 0.08 * (hi - lo)])
    h = pandas_of(stats.histogram(frame(spark, pd.DataFrame({"v": v})), "v", 10), ["bin"])
    assert h["n"].sum() == len(v) and len(h) == 10 and h["n"].iloc[-1] == 1
    one = stats.histogram(frame(spark, pd.DataFrame({"v": [2.0, 2.0]})), "v", 10)
    assert one.agg(F.sum("n")).first()[0] == 2


def test_as_of_is_inclusive(spark):
    df = frame(spark, pd.DataFrame({"ts": minutes(6), "x": range(6)}))
    marks = frame(spark, pd.DataFrame({"ts": minutes(6)[[1, 4]]}))
    got = pandas_of(last_event_before(df, "ts", marks, span=2), ["ts"])["event_ts"]
    assert got.isna().tolist() == [True] + [False] * 5
    assert got.dropna().dt.minute.tolist() == [1, 1, 1, 4, 4]


def test_outer_merge_keeps_first_of_a_name(spark):
    a = frame(spark, pd.DataFrame({"ts": minutes(2), "v": [1.0, 2.0]}))
    b = frame(spark, pd.DataFrame({"ts": minutes(3), "v": [9.0] * 3, "w": [7.0] * 3}))
    got = pandas_of(outer_merge([a, b], "ts"), ["ts"])
    same(got["v"], [1, 2, np.nan])
    same(got["w"], [7, 7, 7])
