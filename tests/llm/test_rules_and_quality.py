import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm.common import durable
from sensorloom.llm.quality_model import FEATURES, described, fit, scored, statistics
from sensorloom.llm.quality_rules import COUNTS, judged, measure, measured


def counted(text):
    blanks = " \t\n\x0b\x0c\r"
    words, cur = [], ""
    for c in text + " ":
        if c in blanks:
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    lines = [x for x in text.split("\n") if any(c not in blanks for c in x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(lines)


@pytest.mark.parametrize("text", ["", "a", "a b c a b c", "a a a a a", "x\ny\nx\n\n \n", "é# *\U0001f600|<b>&$% é", "a b c d a b c x b c d", "r\rs\x0bt\x0c u"])
def test_measures(text):
    assert measure(text.encode()) == counted(text)


def test_rules_on_odd_rows(odd, none):
    rows = durable(measured(odd, keep=["doc_id", "lang", "source"]))
    out = judged(rows).collect()
    assert len(out) == 14
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in out:
        if r.doc_id != 8:
            assert tuple(r[c] for c in COUNTS) == counted(text[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert judged(durable(measured(none, keep=["doc_id", "lang", "source"]))).count() == 0


def test_outliers_of_a_group_go(plain):
    words = [f"w{i:04d}" for i in range(100)]
    rows = [(i, " ".join(words[i % 7 :]), "en", "a") for i in range(200)]
    rows += [(900, " ".join(w + "###" for w in words), "en", "a")]
    rows += [(1000 + i, " ".join(w + "#" for w in words), "x", "code") for i in range(100)]  # usual in its group
    docs = plain(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in judged(durable(measured(docs, keep=["doc_id", "lang", "source"]))).collect()}
    assert not kept.pop(900) and all(kept.values())


def test_discriminant_against_plain_formula(plain):
    good = [f"Sentence number {i} tells of rivers, hills and the people there.\nIt goes on for {i} words." for i in range(80)]
    bad = ["JUNK!! " * (3 + i % 9) + "### $$$ " * (i % 5) for i in range(80)]
    rows = [(i, t, y) for i, (t, y) in enumerate([*((t, 1) for t in good), *((t, 0) for t in bad)])]
    docs = plain(rows, "doc_id long, text string, quality int")
    desc = durable(described(docs, keep=["doc_id", "quality"]))
    model = fit(desc, "quality")
    x = np.array([statistics(t.encode()) for _, t, _ in rows])
    y = np.array([q for *_, q in rows])
    z = (x - x.mean(0)) / np.sqrt(np.maximum(x.var(0), 1e-9))
    cov = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    shared, logs = 0.5 * cov[0] + 0.5 * cov[1], []
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * shared
        c = 0.95 * c + 0.05 * np.trace(c) / len(FEATURES) * np.eye(len(FEATURES))
        d = np.clip(z, -8, 8) - z[y == k].mean(0)
        logs.append(-0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), abs=1e-6)
    got = scored(desc, model).collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_quality_of_odd_rows(odd, none):
    out = scored(described(odd, keep=["doc_id"]), None)
    assert {r.score for r in out.collect()} == {0.5} and out.count() == 14
    assert scored(described(none, keep=["doc_id"]), None).count() == 0
    assert fit(described(odd, keep=["doc_id"]).withColumn("q", F.lit(1)), "q") is None


def test_clashing_names_give_way(odd, none):
    names = [*COUNTS, "Features", "predicted", "base_failed", "n_broken", "Kept", "g_lang", "low_symbols", "high_repeats", "stat_text", "rule_text"]
    more = odd.drop("features").withColumns({n: F.lit("x") for n in names})
    wide, lean = judged(durable(measured(more))), judged(durable(measured(odd, keep=["doc_id", "lang", "source"])))
    same = ["doc_id", *COUNTS, "base_failed", "n_broken", "kept"]
    assert sorted(map(str, wide.select(same).collect())) == sorted(map(str, lean.select(same).collect()))
    assert wide.select("g_lang", "low_symbols", "score").distinct().collect() == [("x", "x", "x")]
    got = scored(described(more), None)
    assert {(r.score, r.predicted, r.n_words) for r in got.collect()} == {(0.5, 0, "x")} and got.count() == 14
    assert "Features" not in got.columns and scored(described(more.limit(0)), None).count() == 0
    assert judged(durable(measured(more.limit(0)))).count() == 0
