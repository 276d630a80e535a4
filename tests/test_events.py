"""Transitions, event response, event study on the reference fixtures and on brute force."""

import numpy as np
import pandas as pd
import pytest
from helpers import frame, minutes, pandas_of, same
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.operators import events as E


def hourly(n, **cols):
    return pd.DataFrame({"ts": minutes(n, freq="1h"), **cols})


def test_transition_table(spark):
    df = frame(spark, hourly(5, ferric_available=[0, 1, 1, 0, 0], hcl_available=[0, 0, 1, 1, 0]))
    got = pandas_of(E.transitions(df, "ts"), ["ts"])
    assert got[["chemical", "event_type"]].to_numpy().tolist() == [
        ["Ferric", "ON"], ["HCl", "ON"], ["Ferric", "OFF"], ["HCl", "OFF"],
    ]
    assert got["ts"].dt.hour.tolist() == [1, 2, 3, 4]


def test_first_row_rule(spark):
    df = frame(spark, hourly(3, ferric_available=[1, 1, 0]))
    strict = pandas_of(E.transitions(df, "ts"), ["ts"])
    assert strict["event_type"].tolist() == ["OFF"]
    first = pandas_of(E.transitions(df, "ts", include_first=True), ["ts"])
    assert first["event_type"].tolist() == ["ON", "OFF"]


def test_only_steps_of_one_and_null_is_off(spark):
    df = frame(spark, hourly(6, s=[0.0, 2.0, 3.0, np.nan, 1.0, np.nan]))
    got = pandas_of(E.transitions(df, "ts", {"S": "s"}), ["ts"])
    assert got[["event_type"]].assign(h=got["ts"].dt.hour).to_numpy().tolist() == [["ON", 2], ["ON", 4], ["OFF", 5]]


def test_response_to_one_event(spark):
    i = np.arange(220)
    df = frame(
        spark,
        hourly(
            220,
            ferric_available=(i >= 72).astype(int),
            hcl_available=np.zeros(220, dtype=int),
            **{
                plant.NH3: np.where(i < 60, 10.0, np.where(i <= 84, 9.0, 5.0)),
                plant.H2S: np.where(i < 60, 4.0, np.where(i <= 84, 3.5, 2.0)),
            },
        ),
    )
    got = pandas_of(E.metrics_table(df, "ts"), ["signal"])
    nh3 = got[got["signal"] == "NH3"].iloc[0]
    assert (nh3["chemical"], nh3["event_type"], nh3["n_events"]) == ("Ferric", "ON", 1)
    same([nh3["baseline"], nh3["post"], nh3["delta"]], [10, 5, -5])


def brute_metrics(pdf, at, col):
    s = pdf.set_index("ts")[col].dropna()
    rel = ((s.index - at).total_seconds() / 60).astype(int)
    s.index = rel
    base = s[(rel >= -2880) & (rel <= -720)]
    post = s[(rel >= 720) & (rel <= 5760)]
    if base.empty or post.empty:
        return None
    b = base.median()
    low = post[post < b]
    return [
        b, post.median(), post.median() - b, (post.median() - b) / b * 100 if b else np.nan, post.idxmin(),
        low.index.max() - low.index.min() if len(low) else 0, post.quantile(0.75) - post.quantile(0.25),
    ]


def test_single_events_against_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 15000
    pdf = pd.DataFrame({"ts": minutes(n), "ferric_available": 0, plant.NH3: rng.integers(0, 6, n).astype(float)})
    pdf.loc[rng.random(n) < 0.3, plant.NH3] = np.nan
    for a, b in ((100, 3000), (5000, 9000), (12500, n)):  # the first has no baseline, the last a short post side
        pdf.loc[a:b, "ferric_available"] = 1
    df = frame(spark, pdf)
    found = E.transitions(df, "ts")
    got = pandas_of(E.per_event_metrics(df, "ts", found), ["event_ts"])
    want = {}
    for at in pd.to_datetime(pandas_of(found, ["ts"])["ts"]):
        m = brute_metrics(pdf, at, plant.NH3)
        if m is not None:
            want[at] = m
    assert got["event_ts"].tolist() == sorted(want)
    same(got[E.METRICS].to_numpy(dtype=float), [want[t] for t in sorted(want)])


def test_nothing_below_baseline_and_ties(spark):
    n = 4000
    v = np.full(n, 1.0)
    v[3700:] = 7.0
    pdf = pd.DataFrame({"ts": minutes(n), "ferric_available": (np.arange(n) >= 2900).astype(int), plant.NH3: v})
    pdf.loc[3621:3699, plant.NH3] = 3.0
    pdf.loc[3620, plant.NH3] = np.nan
    got = E.per_event_metrics(frame(spark, pdf), "ts", E.transitions(frame(spark, pdf), "ts")).toPandas().iloc[0]
    assert got["persistence"] == 0
    assert got["time_to_min"] == 721  # earliest of the equal minima


def test_event_study(spark):
    i = np.arange(240)
    df = frame(
        spark,
        hourly(240, ferric_available=(i >= 80).astype(int), hcl_available=0 * i, **{plant.NH3: np.where(i < 92, 10.0, 7.0)}),
    )
    found = E.transitions(df, "ts").where("chemical = 'Ferric' AND event_type = 'ON'")
    aligned = E.aligned_signal(df, "ts", found, plant.NH3)
    assert aligned.select("event_ts").distinct().count() == 1
    summary = E.study_summary(aligned)
    assert 0 in set(summary.toPandas()["rel_min"])
    assert E.pretrend_check(summary).first()["stable"] is True


def test_pretrend_rules(spark):
    def stable(rows):
        cols = "chemical string, event_type string, rel_min int, median double"
        return E.pretrend_check(spark.createDataFrame(rows, cols)).first()["stable"]

    assert stable([("F", "ON", 5, 1.0)]) is True  # no minute in the window
    assert stable([("F", "ON", -100, None)]) is False  # minutes without values
    assert stable([("F", "ON", -100, 1.0), ("F", "ON", -90, 1.05)]) is True
    assert stable([("F", "ON", -100, 1.0), ("F", "ON", -90, 1.2)]) is False


def test_event_at_the_edge_is_skipped(spark):
    df = frame(spark, hourly(100, ferric_available=[0] + [1] * 99, **{plant.NH3: np.arange(100.0)}))
    assert E.metrics_table(df, "ts").count() == 0


def test_frames_have_closed_ends_and_fractions(spark):
    df = spark.sql(
        "SELECT timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts, s AS v FROM VALUES (0), (30), (3600), (3601) t(s)"
    )
    marks = spark.sql("SELECT timestamp'2026-01-01 00:00:00' AS ts, 'X' AS chemical, 'ON' AS event_type")
    got = pandas_of(E.event_frames(df, "ts", marks, 60), ["v"])
    assert got["minutes"].tolist() == [0.0, 0.5, 60.0]


def test_warnings_and_ranking(spark):
    rows = [("Ferric", "OFF", "NH3", -1.0, -20.0), ("Ferric", "ON", "H2S", 1.0, 50.0), ("HCl", "ON", "H2S", 1.0, None),
            ("HCl", "ON", "NH3", 2.0, 20.0)]
    m = spark.createDataFrame(rows, "chemical string, event_type string, signal string, delta double, percent_change double")
    got = pandas_of(E.flag_unexpected(m), ["chemical", "event_type", "signal"])["warning"].tolist()
    assert got == ["decrease after OFF", "increase after ON", None, "increase after ON"]
    top = [tuple(r)[:3] for r in E.strongest_effects(m).collect()]
    assert top == [("Ferric", "ON", "H2S"), ("Ferric", "OFF", "NH3"), ("HCl", "ON", "NH3")]
    assert E.event_counts(m).count() == 3
    assert pytest.approx(1.0) == E.flag_unexpected(m).agg(F.max("delta")).first()[0] / 2
