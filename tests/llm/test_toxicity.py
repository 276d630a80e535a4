import random

from pyspark.sql import functions as F

from sensorloom.llm.toxicity import Lexicon, Matcher, Scanner, described, fit_weights, learn_lexicon, scored, words

TERMS, STEMS = ("idiot", "scum", "worthless", "moron"), ("lostr", "vequ")
LEX = Lexicon(tuple((t, 3.0) for t in TERMS), tuple((s, 2.0) for s in STEMS), ("idiom",), 8)


def reachable(word, term):
    """Tried out step by step: one edit from 5 letters on; from 8 letters on a second one, behind the term's fourth letter."""
    most = 0 if len(term) < 5 else 1 if len(term) < 8 else 2
    seen, todo = set(), [(0, 0, 0)]
    while todo:
        i, j, e = todo.pop()
        if (i, j, e) in seen or i > len(word) or j > len(term):
            continue
        seen.add((i, j, e))
        if word[i : i + 1] == term[j : j + 1] != "":
            todo.append((i + 1, j + 1, e))
        if e < most and (e == 0 or j >= 4):
            todo += [(i + 1, j, e + 1), (i, j + 1, e + 1), (i + 1, j + 1, e + 1)]
            if i + 1 < len(word) and j + 1 < len(term) and word[i] == term[j + 1] and word[i + 1] == term[j]:
                todo.append((i + 2, j + 2, e + 1))
    return any((len(word), len(term), e) in seen for e in range(3))


def plain(word):
    if word in TERMS:
        return 1
    if any(word.startswith(s) for s in STEMS):
        return 2
    return 3 if word not in LEX.clean and any(reachable(word, t) for t in TERMS if len(t) >= 5) else 0


def test_automaton_matches_plain_edit_distance():
    rng, matcher = random.Random(4), Matcher(LEX)
    made = ["idiot", "idiom", "idiots", "idot", "xidiot", "idoit", "wortles", "worhtless", "wrothless", "owrthles", "scun", "lostra", "vequx", "vequ", "", "i"]
    for _ in range(3000):
        w = list(rng.choice(TERMS + STEMS))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "s"])
        made.append("".join(w))
        if len(w) > 3 and rng.random() < 0.3:
            k = rng.randrange(len(w) - 1)
            made.append("".join([*w[:k], w[k + 1], w[k], *w[k + 2 :]]))
    for w in made:
        assert matcher.find(w)[0] == plain(w), w
    assert [matcher.find(w)[0] for w in ("idoit", "wortles", "idiom", "scun")] == [3, 3, 0, 0]
    once = Matcher(Lexicon(LEX.terms, LEX.stems, LEX.clean))
    assert [once.find(w)[0] for w in ("idoit", "wortles", "worhtless")] == [3, 0, 3]


def test_words_read_signs_as_letters():
    assert words('"Idi0t!" $cum, (ok) 123 ***') == ["idiot", "scum", "ok", "", ""]


def test_quotation_and_context_features():
    scan = Scanner(LEX)
    quoted = scan.features('he said "you are an idiot today" and left')
    said = scan.features("you are an idiot and a moron and scum")
    assert quoted[8] == 1.0 and said[8] == 0.0 and said[9] > quoted[9]
    assert scan.features("nothing here")[:-1] == [0.0] * 11


def test_learning_scores_and_odd_rows(spark, odd, none, plain):
    clean = [f"plain text number {i} about gardens and rivers" for i in range(60)]
    toxic = [f"plain text number {i} you idiot and lostra{'bcdefgh'[i % 7]}x about rivers" for i in range(60)]
    train = plain([(t, 0) for t in clean] + [(t, 1) for t in toxic], "text string, y int").cache()
    lexicon = learn_lexicon(train)
    assert "idiot" in dict(lexicon.terms) and any("lostra".startswith(s[:6]) for s, _ in lexicon.stems)
    seen = described(train, lexicon, keep=["y"]).collect()
    weights = fit_weights([(list(r.features), r.y) for r in seen])
    docs = plain([(1, "you idiot"), (2, "a garden"), (3, None), (4, "you idiott lostrabx")])
    got = {r.doc_id: r for r in scored(described(docs, lexicon, keep=["doc_id"]), weights).collect()}
    assert (got[1].predicted, got[2].predicted, got[3].predicted, got[4].predicted) == (1, 0, 0, 1)
    out = scored(described(odd, lexicon, keep=["doc_id"]), weights)
    assert out.count() == 14 and out.where(~F.col("score").between(0, 1)).count() == 0
    assert scored(described(none, lexicon, keep=["doc_id"]), weights).count() == 0
    clash = scored(described(docs.withColumn("score", F.lit("x")).withColumn("FEATURES", F.lit("y")), lexicon), weights)
    assert "FEATURES" not in clash.columns and clash.columns[-2:] == ["score", "predicted"]
    assert [r.predicted for r in clash.orderBy("doc_id").collect()] == [1, 0, 0, 1]
    assert learn_lexicon(train.limit(0)) == Lexicon((), (), ())
