"""Bucketed windows against the plain global window."""

import numpy as np
import pandas as pd
import pytest
from helpers import frame, minutes, noisy_series, pandas_of, same
from pyspark.sql import functions as F

from sensorloom.operators import windows as W


@pytest.fixture(scope="module")
def keyed(spark):
    a, b = noisy_series(4000, 1), noisy_series(2500, 2, 0.6, "2026-01-02 23:59")
    a["k"], b["k"] = "a", "b"
    both = pd.concat([a, b], ignore_index=True)
    return both, frame(spark, both).cache()


def by_key(pdf, fn):
    return pd.concat([fn(g.sort_values("ts")["v"]) for _, g in pdf.groupby("k")]).to_numpy()


def test_halo_equals_global_window(keyed):
    pdf, df = keyed
    out = W.with_halo(
        df,
        "ts",
        lambda w: {
            "lag": F.lag("v", 60).over(w),
            "lead": F.lead("v", 180).over(w),
            "mean": F.avg("v").over(w.rowsBetween(-59, 0)),
            "max": F.max("v").over(w.rowsBetween(-59, 0)),
        },
        keys=["k"],
        before=60,
        after=180,
    )
    got = pandas_of(out, ["k", "ts"])
    assert len(got) == len(pdf)
    same(got["lag"], by_key(pdf, lambda s: s.shift(60)))
    same(got["lead"], by_key(pdf, lambda s: s.shift(-180)))
    same(got["mean"], by_key(pdf, lambda s: s.rolling(60, min_periods=1).mean()))
    same(got["max"], by_key(pdf, lambda s: s.rolling(60, min_periods=1).max()))


def test_carry_both_ways(keyed):
    pdf, df = keyed
    out = W.carry(df, "ts", last={"p": F.col("v")}, following={"f": F.col("v")}, keys=["k"], span=120)
    got = pandas_of(out, ["k", "ts"])
    same(got["p"], by_key(pdf, lambda s: s.ffill()))
    same(got["f"], by_key(pdf, lambda s: s.bfill()))


def test_carry_exclusive_any_spacing(keyed):
    pdf, df = keyed
    got = pandas_of(W.carry(df, "ts", last={"p": F.col("v")}, keys=["k"], exclusive=True, span=60), ["k", "ts"])
    same(got["p"], by_key(pdf, lambda s: s.ffill().shift()))


def test_forward_fill_default(keyed):
    pdf, df = keyed
    got = pandas_of(W.forward_fill(df, "ts", ["v"], keys=["k"], default=0.0), ["k", "ts"])
    same(got["v"], by_key(pdf, lambda s: s.ffill().fillna(0)))


@pytest.mark.parametrize("window", [2, 30, 1440])
def test_rolling_stats(keyed, window):
    pdf, df = keyed
    got = pandas_of(W.rolling_stats(df, "ts", "v", window, keys=["k"]), ["k", "ts"])
    assert len(got) == len(pdf)
    same(got["roll_count"], by_key(pdf, lambda s: s.rolling(window, min_periods=0).count()))
    same(got["roll_mean"], by_key(pdf, lambda s: s.rolling(window, min_periods=1).mean()))
    want = by_key(pdf, lambda s: pd.Series([s.iloc[max(0, i - window + 1) : i + 1].std() for i in range(len(s))]))
    same(got["roll_sd"], want)


def test_rolling_stats_flat_run_has_zero_spread(spark):
    pdf = pd.DataFrame({"ts": minutes(400), "v": np.r_[np.random.default_rng(0).normal(1e6, 50, 100), np.full(300, 0.1)]})
    got = pandas_of(W.rolling_stats(frame(spark, pdf), "ts", "v", 60), ["ts"])
    assert (got["roll_sd"].iloc[160:] == 0.0).all()
    assert got["roll_sd"].iloc[120] > 0


def test_row_position_and_split(keyed, spark):
    pdf, df = keyed
    got = pandas_of(W.row_position(df, "ts", keys=["k"], span=90), ["k", "ts"])
    assert got["position"].tolist() == [*range(4000), *range(2500)]
    assert set(got["total"]) == {4000, 2500}
    split = pandas_of(W.chronological_split(df, "ts", keys=["k"], train=0.7, validation=0.85), ["k", "ts"])
    assert split.groupby(["k", "split"]).size().to_dict() == {
        ("a", "train"): int(4000 * 0.7), ("a", "validation"): int(4000 * 0.85) - int(4000 * 0.7),
        ("a", "test"): 4000 - int(4000 * 0.85), ("b", "train"): int(2500 * 0.7),
        ("b", "validation"): int(2500 * 0.85) - int(2500 * 0.7), ("b", "test"): 2500 - int(2500 * 0.85),
    }


def test_split_cuts_at_published_size(spark):
    n = spark.range(1).select(F.lit(238980).cast("double").alias("n"))
    row = n.select(F.floor(F.col("n") * F.lit(0.70)), F.floor(F.col("n") * F.lit(0.85))).first()
    assert tuple(row) == (167286, 203133)


def test_no_fact_table_in_one_partition(keyed):
    _, df = keyed
    plan = W.with_halo(df, "ts", lambda w: {"x": F.lag("v", 5).over(w)}, before=5)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
