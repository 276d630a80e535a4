import numpy as np
import pandas as pd
import pytest
from helpers import frame, pandas_of, same
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sensorloom.operators.quantiles import exact_quantiles
from sensorloom.operators.stats import box_summary

PROBS = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]


def check(spark, pdf, by):
    got = exact_quantiles(frame(spark, pdf), "v", PROBS, by=by)
    if not by:
        same(np.asarray(got.toPandas().iloc[0], dtype=float), pdf["v"].quantile(PROBS), 1e-12)
        return
    want = pdf.dropna().groupby(by)["v"].quantile(PROBS).unstack()
    got = pandas_of(got, by).set_index(by)
    assert list(got.index) == list(want.index)
    same(got.to_numpy(), want.to_numpy(), 1e-12)


def test_against_pandas_by_group(spark):
    rng = np.random.default_rng(3)
    v = np.r_[rng.normal(0, 1, 3000), rng.exponential(1e-8, 500), -rng.pareto(1, 500) * 1e9, np.zeros(400), [np.nan] * 50]
    pdf = pd.DataFrame({"g": rng.integers(0, 4, len(v)), "v": v})
    check(spark, pdf, ["g"])
    check(spark, pdf, [])


def test_neighbouring_powers_of_two(spark):
    base = 2.0 ** np.arange(-40, 41)
    v = np.r_[np.nextafter(base, 0), base, np.nextafter(base, np.inf), -base, 0.0]
    check(spark, pd.DataFrame({"v": v}), [])


def test_values_that_share_every_leading_bit(spark):
    v = 1.0 + np.arange(5000) * 2.0**-50
    check(spark, pd.DataFrame({"v": np.random.default_rng(1).permutation(v)}), [])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40))
def test_any_floats(spark, values):
    check(spark, pd.DataFrame({"v": np.asarray(values, dtype=float)}), [])


def grouped():
    rng = np.random.default_rng(8)
    v = np.r_[rng.normal(0, 1, 800), rng.exponential(1e5, 300), np.full(200, 0.5), [np.nan] * 40]
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], len(v)), "v": v})
    return pd.concat([pdf, pd.DataFrame({"g": ["empty"] * 3, "v": [np.nan] * 3})], ignore_index=True)


@pytest.mark.parametrize("stored", [False, True])
def test_groups_and_the_whole_in_one_search(spark, stored):
    pdf = grouped()
    out = exact_quantiles(frame(spark, pdf), "v", PROBS, by=["g"], stored=stored, overall="whole").toPandas()
    whole = out[out.whole]
    assert len(whole) == 1 and whole.g.isna().all()
    names = [f"q{i}" for i in range(len(PROBS))]
    same(whole[names].to_numpy()[0], pdf["v"].quantile(PROBS), 1e-12)
    own = out[~out.whole].set_index("g").sort_index()
    want = pdf.dropna().groupby("g")["v"].quantile(PROBS).unstack()
    assert list(own.index) == list(want.index) == ["a", "b", "c"]
    same(own[names].to_numpy(), want.to_numpy(), 1e-12)
    none = exact_quantiles(frame(spark, pdf).limit(0), "v", PROBS, by=["g"], stored=stored, overall="whole")
    assert none.count() == 0


def test_box_summary_with_odd_phases(spark):
    pdf = grouped()
    got = pandas_of(box_summary(frame(spark, pdf), "g", "v", stored=True), ["phase"]).set_index("phase")
    assert list(got.index) == ["a", "b", "c", "empty"]
    want = pdf.dropna(subset=["g"]).groupby("g")["v"]
    assert got["n"].tolist() == want.count().tolist()
    for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        same(got[c][:3], want.quantile(p)[:3])
    same(got["high"][:3], want.max()[:3])
    same(got["sd"][:3], want.std()[:3])
    assert got.loc["empty", ["low", "median", "sd"]].isna().all()
    assert got["log_axis"].tolist() == [bool(pdf["v"].max() > 10 * pdf["v"].median())] * 4
