import math
import random

from pyspark.sql import functions as F

from sensorloom.llm import bitslice
from sensorloom.llm.bitslice import top_k


def plain(rows, k, scale):
    ok = {i: [math.floor(scale * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 3:
            continue
        best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k, scale=256):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, asks int").repartition(3)
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 3 == 0, k, scale=scale).collect()))


def test_matches_plain_search_with_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)], "x", 1) for i in range(400)]
    rows += [(i, [0.5, -0.25] * 6, "x", 1) for i in range(400, 560)]  # many equal ones
    rows += [(i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(12)], "x", 1) for i in range(600, 700)]
    assert run(spark, rows, 5) == plain([r[:2] for r in rows], 5, 256)


def test_many_blocks_meet_runs_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bitslice, "GROUP", 4)
    monkeypatch.setattr(bitslice, "GROUPS_A_ROW", 2)
    met = []
    inner = bitslice._best
    monkeypatch.setattr(bitslice, "_best", lambda df, k, dims: met.append(df) or inner(df, k, dims))
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)], "x", 1) for i in range(1500)]
    assert run(spark, rows, 3) == plain([r[:2] for r in rows], 3, 256)
    size = met[0].agg(F.max(F.size("asked")).alias("m"), F.count("*").alias("n")).first()
    assert size.m < 40 and size.n > 24 * 8  # 500 queries, hashed to groups of about 4, two groups in a row


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [-1.0, 3.0, 4.0])]
    rows += [(9, [1e6, -1e6]), (None, [1.0, 1.0]), (12, [0.0, 0.0])]
    full = [(i, v, "x", 1) for i, v in rows]
    assert run(spark, full, 5) == plain(rows, 5, 256)
    assert run(spark, [(0, [1.0], "x", 1)], 5) == []
    assert run(spark, full, 5, scale=256)[0][1] == 1
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 3 == 0, 5).count() == 0
