import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm.mixing import Mix, Plan, _shard_counts, mixed, permuted, taken_words, targets


def plain_targets(sizes, mix):
    weight = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    total, open_, out = mix.share * sum(sizes), set(range(len(sizes))), {}
    while True:
        level = total / max(sum(weight[i] for i in open_), 1e-9)
        over = {i for i in open_ if level * weight[i] > mix.repeat * sizes[i]}
        if not over:
            return [out.get(i, level * weight[i]) for i in range(len(sizes))]
        for i in over:
            out[i] = float(mix.repeat * sizes[i])
            total -= out[i]
        open_ -= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 50, 5], [0, 7, 3], [1]])
def test_targets(spark, sizes):
    rows = [(f"s{i:02d}", n) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in targets(spark.createDataFrame(rows, "source string, size long"), Mix()).collect()}
    assert [got[s] for s, _ in rows] == pytest.approx(plain_targets(sizes, Mix()))


def test_null_source_is_last(spark):
    df = spark.createDataFrame([(None, 5), ("Z", 5), ("a", 5), ("é", 5)], "source string, size long")
    assert {r.source: r.source_no for r in targets(df, Mix()).collect()} == {"Z": 0, "a": 1, "é": 2, None: 3}


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    assert sorted(permuted(np.arange(n), n, 99).tolist()) == list(range(n))


def test_shards_add_up():
    plan = Plan((0, 1, 2), (1000, 50_000, 7), (1500, 61_234, 14), 16)
    shards = -(-int(plan.slots.sum()) // 64)
    at = np.zeros(3, dtype=np.int64)
    for s in range(shards):
        have, before = _shard_counts(plan, s, shards, 64, 1)
        assert (before == at).all() and have.sum() <= 64
        at += have
    assert (at == plan.slots).all()


def test_mix_takes_the_target(odd, none):
    mix = Mix(block=16, shard=32)
    rows = taken_words(odd, mix).collect()
    assert sorted(r.doc_id or -1 for r in rows) == sorted(r.doc_id or -1 for r in odd.collect())
    size = {r.doc_id: len((r.text or "").encode().split()) for r in odd.collect()}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in rows)
    for target in {r.target for r in rows}:
        assert abs(sum(r.taken for r in rows if r.target == target) - target * len({r.source_size for r in rows if r.target == target})) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, taken_words(odd, mix).collect()))
    assert taken_words(none, mix).count() == 0


def test_texts_of_the_mix(odd, none):
    mix = Mix(block=16, shard=32)
    out = mixed(odd, mix, size="n_chars")
    assert out.columns == odd.columns and out.schema["text"].dataType == odd.schema["text"].dataType
    got = out.collect()
    words = {r.doc_id: (r.text or "").encode().split() for r in odd.collect()}
    want = {r.doc_id: 0 for r in odd.collect()}
    for r in taken_words(odd, mix).collect():
        want[r.doc_id] += r.taken
    for i, n in want.items():
        mine = [r for r in got if r.doc_id == i]
        assert sum(len(r.text.encode().split()) for r in mine) == n
        assert all(set(r.text.encode().split()) <= set(words[i]) and r.n_chars == len(r.text) for r in mine)
    assert mixed(none, mix).count() == 0


def test_one_source_with_most_rows(plain):
    docs = plain([(i, "w " * 40, "hot" if i % 10 else f"s{i % 7}") for i in range(2000)], "doc_id long, text string, source string")
    per = taken_words(docs, Mix(block=32)).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert abs(sum(r.t for r in per) - 1.5 * 80_000) <= 8
