"""Boosting against a plain row-by-row version; training outputs read back."""

import numpy as np
import pandas as pd
import pytest

from sensorloom.operators import boosting
from sensorloom.operators.boosting import Boosted, Settings, fit, predict
from helpers import frame, minutes, pandas_of, same


def table(n, seed, missing=0.2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] + rng.normal(size=n) * 0.05
    lost = rng.random((n, 4)) < missing
    lost[:, 0] |= x[:, 0] > 1.2  # missing goes with the high side
    x[lost] = np.nan
    x[:, 3] = 1.0
    return x, y


def plain(x, y, cuts, s):
    """Best-first trees, every split tried on the rows themselves."""
    bins = len(max(cuts, key=len)) + 1
    classes = np.column_stack([np.where(np.isnan(x[:, i]), bins, np.searchsorted(c, x[:, i])) for i, c in enumerate(cuts)])
    out = np.full(len(y), y.mean())

    def split(rows, r):
        best = None
        for missing_left in (False, True):
            for f, cut in enumerate(cuts):
                lost = classes[rows, f] == bins
                if missing_left and not lost.any():
                    continue
                for c in range(bins):
                    left = (classes[rows, f] <= c) & ~lost | (lost & missing_left)
                    n, m = left.sum(), (~left).sum()
                    if n < s.min_leaf or m < s.min_leaf or c >= bins - 1 + 1:
                        continue
                    a, b = r[left].sum(), r[~left].sum()
                    gain = a**2 / (n + s.l2) + b**2 / (m + s.l2) - (a + b) ** 2 / (n + m + s.l2)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = gain, rows[left], rows[~left]
        return best

    for _ in range(s.rounds):
        r = y - out
        leaves = [(np.arange(len(y)), 0)]
        options = {0: split(leaves[0][0], r)}
        while len(leaves) < s.leaves:
            k = max((k for k, o in options.items() if o), key=lambda k: options[k][0], default=None)
            if k is None:
                break
            _, a, b = options[k]
            depth = leaves[k][1] + 1
            leaves[k] = (a, depth)
            leaves.append((b, depth))
            for i in (k, len(leaves) - 1):
                options[i] = split(leaves[i][0], r[leaves[i][0]]) if depth < s.depth else None
        for rows, _ in leaves:
            out[rows] += s.rate * r[rows].sum() / (len(rows) + s.l2)
    return out


def spark_rows(spark, x, y):
    return frame(spark, pd.DataFrame({**{f"f{i}": x[:, i] for i in range(x.shape[1])}, "y": y, "id": np.arange(len(y))}))


@pytest.mark.parametrize("parts,few", [(1, 8), (5, 8), (5, 1)])
def test_equals_the_plain_version(spark, monkeypatch, parts, few):
    monkeypatch.setattr(boosting, "PART_ROWS", 1 if parts > 1 else 1 << 15)
    monkeypatch.setattr(boosting, "FEW_PARTS", few)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    from sensorloom.sources.sinks import settle

    x, y = table(300, 1)
    s = Settings(rounds=4, rate=0.3, depth=3, leaves=5, min_leaf=10, l2=0.1, bins=20)
    rows = settle(spark_rows(spark, x, y).repartition(parts))
    model = fit(rows, "y", ["f0", "f1", "f2", "f3"], s)
    assert len(model.trees) == 4 and all((np.array(t.feature) < 0).sum() <= 5 for t in model.trees) and not model.cuts[3]
    want = plain(x, y, model.cuts, s)
    same(pandas_of(predict(model, rows), ["id"])["y_pred_model"], want, 1e-9)
    same(Boosted.from_json(model.to_json()).predict(x), want, 1e-9)


def test_missing_rows_follow_the_better_side(spark):
    x, y = table(800, 2, missing=0.0)
    rows = spark_rows(spark, x, y)
    model = fit(rows, "y", ["f0"], Settings(rounds=1, rate=1.0, depth=1, min_leaf=20, l2=0.0))
    tree = model.trees[0]
    assert tree.feature[0] == 0 and not tree.missing_left[0]
    known, lost = y[x[:, 0] > 0.3].mean(), model.predict(np.array([[np.nan]]))[0]
    assert lost > 1.5 and abs(lost - known) < 0.5


def test_odd_tables(spark):
    s = Settings(rounds=3, min_leaf=2)
    none = fit(frame(spark, pd.DataFrame({"f": [1.0, 2.0], "y": [3.0, 5.0]})), "y", ["f"], s)
    assert not none.trees and none.start == 4.0
    flat = fit(frame(spark, pd.DataFrame({"f": [None, None, 1.0, 1.0] * 3, "y": [1.0, 1.0, 9.0, 9.0] * 3})), "y", ["f"], s)
    got = flat.predict(np.array([[np.nan], [1.0], [7.0]]))
    assert not flat.cuts[0] and len(set(got.round(9))) == 1  # one known class: nothing to cut
    assert fit(frame(spark, pd.DataFrame({"y": [1.0, 3.0]})), "y", [], s).predict(np.empty((2, 0))).tolist() == [2.0, 2.0]
    with pytest.raises(ValueError):
        predict(none, frame(spark, pd.DataFrame({"f": [1.0], "y_pred_model": [0.0]})))


def test_training_outputs_read_back(spark, tmp_path):
    from sensorloom.plans.training import read_training, train_all, write_training

    rng = np.random.default_rng(4)
    n = 900
    v = np.sin(np.arange(n) / 40) * 3 + 4 + rng.normal(size=n) * 0.1
    pdf = pd.DataFrame({"ts": minutes(n), "v": v, "w": np.where(rng.random(n) < 0.3, np.nan, v**2), "ok": 1})
    pdf["v_t_plus_60min"] = pdf["v"].shift(-60)
    df = frame(spark, pdf)
    targets = {"v60": {"target": "v_t_plus_60min", "current": "v", "valid": "ok", "limit": 5.0}, "none": {"target": "v_t_plus_60min", "current": "v", "valid": "zero"}}
    from pyspark.sql import functions as F

    df = df.withColumn("zero", F.lit(0))
    results = train_all(df, "ts", targets=targets, rounds=8, min_leaf=10)
    path = str(tmp_path / "models")
    assert read_training(spark, path) is None
    run = write_training(df, results, path, source="here")
    again, summary = read_training(spark, path)
    assert again["none"].model is None and again["none"].predictions.count() == 0
    assert again["v60"].model.to_json() == results["v60"].model.to_json()
    a, b = (pandas_of(r["v60"].predictions, ["timestamp"]) for r in (results, again))
    pd.testing.assert_frame_equal(a, b)
    order = ["split", "forecaster"]
    a, b = (pandas_of(r["v60"].metrics, order) for r in (results, again))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(a)], check_dtype=False)
    assert a.set_index(order).loc[("train", "model"), "r2"] > 0.05
    row = summary.first()
    assert (row.n_total_rows, row.n_feature_columns, row.source, row.targets) == (n, 4, "here", ["v60", "none"])
    assert write_training(df, results, path) != run  # a later run replaces the manifest, not the earlier files
