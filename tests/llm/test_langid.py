import random

import numpy as np
from pyspark.sql import functions as F

from sensorloom.llm.langid import BLOCK, Parser, Samples, accept, identify, learn, packed, suffix_automaton, symbols

TRAIN = Samples(("de", "en"), ("der hund und die katze schlafen auf dem warmen sofa im haus", "the dog and the cat sleep on the warm sofa in the house"))


def plain_phrases(text, train):
    """Longest matches found by plain search, block by block."""
    text, train = symbols(text), symbols(train)
    hay, n = "".join(map(chr, train)), 0
    for b in range(0, len(text), BLOCK):
        s = "".join(map(chr, text[b : b + BLOCK]))
        while s:
            k = 1
            while k <= len(s) and s[:k] in hay:
                k += 1
            s = s[max(1, k - 1) :]
            n += 1
    return n


def test_phrases_match_plain_search():
    parser = Parser(TRAIN)
    docs = ["the cat", "die katze und ein hund!", "zzz qqq", "", "x" * 1200 + " the house", "1 2 3", "Ünïcode the"]
    got = parser.phrases([symbols(d) for d in docs])
    want = [[plain_phrases(d, t) for t in TRAIN.texts] for d in docs]
    assert got.tolist() == want


def test_packed_steps():
    rng = random.Random(5)
    for letters, n in ((2, 300), (40, 700), (3000, 900), (5, 0)):
        steps = suffix_automaton(np.array([rng.randrange(letters) for _ in range(n)], dtype=np.uint16))
        base, owner, target = packed(steps, letters)
        for s, out in enumerate(steps):
            held = {c: int(target[base[s] + c]) for c in range(letters) if owner[base[s] + c] == s}
            assert held == out
        assert (owner >= 0).sum() == sum(map(len, steps))


def test_languages_of_many_letters():
    rng = random.Random(9)
    samples = ["".join(chr(0x4E00 + min(int(rng.expovariate(0.002)), 6000)) for _ in range(24_000)) for _ in range(3)]
    parser = Parser(Samples(("x", "y", "z"), tuple(samples)))
    assert sum(a.nbytes for t in parser.tables for a in t) < 20 << 20
    docs = [samples[0][500:900], samples[1][20_000:20_700] + "\u9fff tail", samples[2][:40][::-1]]
    want = [[plain_phrases(d, t) for t in samples] for d in docs]
    assert parser.phrases([symbols(d) for d in docs]).tolist() == want
    assert parser.decide(docs[:2])[0] == ["x", "y"]


def test_clashing_names_give_way(odd):
    wide = odd.withColumn("Lang_Pred", F.lit("x")).drop("lang_pred", "score").withColumn("SCORE", F.lit("x"))
    out = identify(wide, TRAIN)
    assert [c for c in out.columns if c.lower() in ("lang_pred", "score")] == ["lang_pred", "score"]
    assert identify(odd, TRAIN).select("doc_id", "lang_pred").count() == 14


def test_decisions(plain):
    docs = plain([(1, "the warm house"), (2, "das warme haus und der hund"), (3, None), (4, "12 34 !"), (5, "")])
    got = {r.doc_id: r for r in identify(docs, TRAIN, keep=["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0


def test_learning_and_odd_rows(odd, none):
    samples = learn(odd, F.lit(True))
    assert samples.langs == ("de", "en", "fr")
    out = {r.doc_id: r.lang_pred for r in identify(odd, samples, keep=["doc_id"]).collect()}
    assert (out[1], out[3], out[5], out[6], out[12], out[8]) == ("en", "de", "und", "und", "und", "en")
    assert learn(none, F.lit(True)) == Samples((), ())
    assert {r.lang_pred for r in identify(odd, Samples((), ()), keep=["doc_id"]).collect()} == {"und"}
    kept = accept(odd, samples)
    assert kept.columns == odd.columns and {5, 6, 7, 12}.isdisjoint({r.doc_id for r in kept.collect()})
    assert accept(none, samples).count() == 0


def test_long_documents_and_copies(plain):
    long = [(i, f"{i} " + "der hund und die katze schlafen auf dem warmen sofa im haus " * 90, "de") for i in range(3)]
    copies = [(10 + i, "the same words over and over again", "en") for i in range(40)]
    other = [(60 + i, f"the dog number {i} sleeps in the warm house", "en") for i in range(5)]
    docs = plain([*long, *copies, *other], "doc_id long, text string, lang string")
    samples = learn(docs, F.lit(True))
    assert samples.langs == ("de", "en")
    de, en = samples.texts
    assert len(de) == 3 * 4000 + 2 and de.count("schlafen") > 100
    assert en.count("over and over") == 1 and en.count("the dog number") == 5
    got = {r.doc_id: r.lang_pred for r in identify(docs, samples, keep=["doc_id"]).collect()}
    assert got[0] == "de" and got[10] == "en"


def test_held_out_accuracy(spark):
    from sensorloom.llm.op07 import op7_language_id

    folder = "/root/testdata/sf0.001"
    got = op7_language_id(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").toPandas()
    assert np.mean(got.lang == got.lang_pred) > 0.95
