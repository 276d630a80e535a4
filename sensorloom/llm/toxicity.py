"""Toxicity: a learned lexicon as a trie, met by Levenshtein automata, with scores from the context of each hit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sensorloom.functions.names import col
from sensorloom.llm.common import fresh, slices, texts, with_columns

#: Labelled rows that the lexicon and the weights are learned from, at most, drawn by a hash of the id.
SAMPLE = 24_000
#: A term is in the lexicon if it is in enough toxic documents and its share of toxic ones is high enough.
LEAST_DOCS, LEAST_SHARE, STEM = 4, 0.9, (3, 8)
#: Letters of the longest word that can be a term; a longer run without blanks isn't a word.
LONGEST = 40
#: Letters from which one edit is allowed in a whole term; shorter terms and stems must be met exactly.
EDIT_FROM = 5
#: Letters of the term that must come before a second edit, where a lexicon allows one.
TWICE_AFTER = 4
#: Words on each side of a hit that make up its context.
CONTEXT = 6
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "’": "'"})
_TOKEN = re.compile(r"[^\s]+")
_EDGE = "\"'“”„«»‹›‘’()[]{}<>.,;:!?*|&%#-_=+/\\~`^"
_QUOTES = "\"“”„«»‹›"
FEATURES = (
    "exact hits", "best exact", "exact words", "stem hits", "best stem", "stem words", "edit hits", "best edit",
    "quoted share", "densest context", "share of words", "log words",
)


@dataclass(frozen=True)
class Lexicon:
    """Whole words and stems that begin words, each with its log odds, and clean words within the edits of a term."""

    terms: tuple[tuple[str, float], ...]
    stems: tuple[tuple[str, float], ...]
    clean: tuple[str, ...]
    #: Letters from which a term may be met with a second edit; 0: never. Clean words that the labelled rows don't hold
    #: are then met more often: on a fold of the training rows, 13 clean documents of 804 were marked instead of 4.
    twice_from: int = 0


def words(text: str) -> list[str]:
    """Tokens between blanks, lower-cased, without marks at their ends and with look-alike signs read as letters."""
    out = []
    for token in text.lower().split():
        bare = token.strip(_EDGE)
        if bare and not bare.isalpha():
            plain = token.translate(_PLAIN).strip(_EDGE)
            bare = plain if plain.isalpha() else "".join(c for c in plain if c.isalpha()) if any(map(str.isalpha, bare)) else ""
        out.append(bare)
    return out


# ------------------------------------------------------------------ automaton
class Matcher:
    """The Levenshtein automaton of a word run over the trie of the lexicon, made deterministic as it is used.

    A state is the set of (trie node, edits so far, letter owed) that the letters read may have led to; a letter is owed in
    the middle of two swapped ones. Which next state a letter leads to is worked out once and kept, so that a word costs a
    step per letter. An edit is a letter left out, added, replaced, or swapped with its neighbour.
    """

    KEPT = 200_000

    def __init__(self, lexicon: Lexicon):
        self.clean = frozenset(lexicon.clean)
        self.twice_from = lexicon.twice_from or float("inf")
        self.child: list[dict[str, int]] = [{}]
        self.term: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.reach: list[int] = [0]  # length of the longest term below a node
        self.depth: list[int] = [0]
        for entries, odds in ((lexicon.terms, self.term), (lexicon.stems, self.stem)):
            for w, weight in entries:
                at, path = 0, [0]
                for c in w:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        self.term.append(0.0)
                        self.stem.append(0.0)
                        self.reach.append(0)
                        self.depth.append(self.depth[at] + 1)
                    at = self.child[at][c]
                    path.append(at)
                odds[at] = weight
                if odds is self.term:
                    for p in path:
                        self.reach[p] = max(self.reach[p], len(w))
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.value: list[tuple[float, float, float]] = []  # log odds: as a term, within an edit, as a stem
        self.begin = self._state(self._closed({(0, 0, "")}))

    def _may(self, node: int, edits: int) -> bool:
        """One more edit behind the node can still lead to a term that allows it."""
        if edits == 0:
            return self.reach[node] >= EDIT_FROM
        return edits == 1 and self.reach[node] >= self.twice_from and self.depth[node] >= TWICE_AFTER

    def _closed(self, states: set) -> frozenset:
        """With letters of the term left out: an edit that reads nothing."""
        least: dict[tuple[int, str], int] = {}
        todo = sorted(states, key=lambda x: -x[1])
        while todo:
            s, e, owed = todo.pop()
            if least.get((s, owed), 3) <= e:
                continue
            least[s, owed] = e
            if not owed and self._may(s, e):
                todo += [(n, e + 1, "") for n in self.child[s].values()]
        return frozenset((s, e, owed) for (s, owed), e in least.items())

    def _state(self, states: frozenset) -> int:
        got = self.ids.get(states)
        if got is None:
            got = self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.step.append({})
            whole = [(s, e) for s, e, owed in states if not owed]
            exact = max((self.term[s] for s, e in whole if e == 0), default=0.0)
            near = max((self.term[s] for s, e in whole if e and self.depth[s] >= (0, EDIT_FROM, self.twice_from)[e]), default=0.0)
            stem = max((self.stem[s] for s, e in whole if e == 0), default=0.0)
            self.value.append((exact, near, stem))
        return got

    def _next(self, state: int, c: str) -> int:
        out = set()
        for s, e, owed in self.sets[state]:
            if owed:
                if owed == c:
                    out.add((s, e, ""))
                continue
            n = self.child[s].get(c)
            if n is not None:
                out.add((n, e, ""))
            if self._may(s, e):
                out.add((s, e + 1, ""))  # a letter too many
                for x, to in self.child[s].items():
                    out.add((to, e + 1, ""))  # another letter
                    beyond = self.child[to].get(c)
                    if beyond is not None and x != c:
                        out.add((beyond, e + 1, x))  # the next two letters swapped
        self.step[state][c] = got = self._state(self._closed(out))
        return got

    def find(self, word: str) -> tuple[int, float]:
        """Kind and log odds: 1 a term, 2 begins with a stem, 3 within the edits of a term and not known as clean; else 0."""
        state, stem = self.begin, 0.0
        step, value = self.step, self.value
        for c in word:
            to = step[state].get(c)
            state = self._next(state, c) if to is None else to
            stem = max(stem, value[state][2])
            if not self.sets[state]:
                break
        exact, near, _ = value[state]
        if exact:
            return 1, max(exact, stem)
        if stem:
            return 2, stem
        return (3, near) if near and word not in self.clean else (0, 0.0)

    def tidy(self) -> None:
        if len(self.sets) > self.KEPT:
            self._reset()


class Scanner:
    """Features of a text: hits by kind, and what stands around them."""

    REMEMBERED = 400_000

    def __init__(self, lexicon: Lexicon):
        self.matcher, self.known = Matcher(lexicon), {}

    def features(self, text: str) -> list[float]:
        if len(self.known) > self.REMEMBERED:
            self.known = {}
            self.matcher.tidy()
        tokens = text.split()
        known = self.known
        new = set(tokens).difference(known)
        for t in new:
            w = words(t)
            known[t] = (self.matcher.find(w[0]) if w and w[0] else None) or None
            if known[t] == (0, 0.0):
                known[t] = None
        found = list(map(known.__getitem__, tokens))
        for t in new:
            if len(t) > 64:
                del known[t]
        size = float(np.log1p(len(tokens)))
        hits = [i for i, k in enumerate(found) if k]
        if not hits:
            return [0.0] * (len(FEATURES) - 1) + [size]
        out = []
        for kind in (1, 2, 3):
            of = [found[i][1] for i in hits if found[i][0] == kind]
            out += [float(np.log1p(len(of))), max(of, default=0.0)]
            if kind < 3:
                out.append(float(np.log1p(len({tokens[i].lower().strip(_EDGE) for i in hits if found[i][0] == kind}))))
        quoted = 0
        for i in hits:
            before = " ".join(tokens[max(0, i - CONTEXT) : i]) + " " + tokens[i][:1]
            after = tokens[i][-1:] + " " + " ".join(tokens[i + 1 : i + 1 + CONTEXT])
            quoted += any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
        at = np.array(hits)
        densest = int((np.searchsorted(at, at + CONTEXT, side="right") - np.arange(len(at))).max())
        return [*out, quoted / len(hits), float(np.log(densest)), float(np.sqrt(len(hits) / len(tokens))), size]


@lru_cache(maxsize=2)
def scanner(lexicon: Lexicon) -> Scanner:
    return Scanner(lexicon)


# ------------------------------------------------------------------- learning
def sample(labelled: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """About ``rows`` labelled rows at most, the same on each run: those with the smallest hashes of their id."""
    n = labelled.count()
    return labelled if n <= rows else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def _prefixes(word: str) -> list[str]:
    return [word[:k] for k in range(STEM[0], min(STEM[1], len(word) - 1) + 1)]


def learn_lexicon(labelled: DataFrame, *, twice_from: int = 0) -> Lexicon:
    """From ``(text, y)``: terms, stems and clean neighbours of terms.

    A term or stem must be in at least ``LEAST_DOCS`` toxic documents, and ``LEAST_SHARE`` of its documents, weighted as if
    both classes were equally many, must be toxic. A stem carries four words or more. Spark counts documents per word; the
    prefixes that could pass by the sums over their words are then counted per document. All that pass are taken, and all
    clean words within the edits of a term: the only bound is that of the labelled rows. Words longer than ``LONGEST``
    are no terms. Repeated rows count each time; an empty table, or one class alone, gives an empty lexicon.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ys = part.column("y").to_pylist()
            found = [sorted(set(words(t)) - {""}) for t in texts(part)]
            flat = [w for ws in found for w in ws]
            tox = [y for y, ws in zip(ys, found) for _ in ws]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.string()), pa.array(tox, pa.int64())], names=["word", "y"])

    totals = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("tox")).first()
    tox, other = totals.tox or 0, (totals.n or 0) - (totals.tox or 0)
    if not tox or not other:
        return Lexicon((), (), ())
    given = labelled.select("text", F.col("y").cast("long").alias("y"))
    counts = [F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")]
    per_word = given.mapInArrow(split, "word string, y long").groupBy("word").agg(*counts).where(F.length("word") <= LONGEST)

    def telling(df: DataFrame, share: float) -> list[tuple[str, float]]:
        toxic_share = (F.col("t") / tox) / (F.col("t") / tox + F.col("c") / other)
        odds = F.log((F.col("t") + 0.5) / (tox + 1)) - F.log((F.col("c") + 0.5) / (other + 1))
        best = df.where((F.col("t") >= LEAST_DOCS) & (toxic_share >= share)).orderBy(F.desc("t"), "word")
        return [(r.word, round(r.odds, 6)) for r in best.select("word", odds.alias("odds")).collect()]

    lengths = F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("word") - 1))
    long_enough = per_word.where(F.length("word") > STEM[0])
    by_prefix = long_enough.select(F.explode(F.transform(lengths, lambda k: F.left("word", k))).alias("word"), "t", "c")
    sums = by_prefix.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("kinds"))
    likely = frozenset(w for w, _ in telling(sums.where("kinds >= 4"), 0.6))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ys = part.column("y").to_pylist()
            found = [sorted(likely.intersection(*[[p for w in set(words(t)) for p in _prefixes(w)]])) for t in texts(part)]
            flat = [w for ws in found for w in ws]
            tox_ = [y for y, ws in zip(ys, found) for _ in ws]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.string()), pa.array(tox_, pa.int64())], names=["word", "y"])

    stems = telling(given.mapInArrow(met, "word string, y long").groupBy("word").agg(*counts), LEAST_SHARE)
    terms = telling(per_word, LEAST_SHARE)
    trial = Lexicon(tuple(sorted(terms)), tuple(sorted(stems)), (), twice_from)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(trial)
        for b in batches:
            hits = [matcher.find(w)[0] == 3 for w in b.column("word").to_pylist()]
            yield b.filter(pa.array(hits, pa.bool_()))

    clean = per_word.where("c > 0").select("word", "c").mapInArrow(near, "word string, c long")
    clean_words = [r.word for r in clean.select("word").collect()]
    return Lexicon(trial.terms, trial.stems, tuple(sorted(clean_words)), twice_from)


def described(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) and ``features`` of the whole text; null texts are empty, very long ones are read whole.

    A kept column named like one of the results (features, score, predicted) gives way to it. An empty table gives an
    empty result; equal texts get equal features.
    """
    carried = fresh(docs, "tox_text")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("features", "score", "predicted")]
    base = docs.select(*[col(c) for c in kept], col(text).cast("string").alias(carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for part in slices(batches, carried):
            scan = scan or scanner(lexicon)
            rows = pa.array([scan.features(t) for t in texts(part, carried)], type=pa.list_(pa.float64()))
            yield with_columns(part, {carried}, features=rows)

    schema = StructType([*base.schema.fields[:-1], StructField("features", ArrayType(DoubleType()))])
    return base.mapInArrow(run, schema)


def fit_weights(rows: list[tuple[list[float], int]], steps: int = 40) -> tuple[float, ...]:
    """Ridge logistic weights, the bias first, by Newton steps on a bounded sample.

    The ridge pulls to a prior in which hits count as toxic, more for exact ones and less inside quotation marks: where
    the labels hold no case of a kind, the prior speaks.
    """
    prior = np.array([-4.0, 0.5, 0.7, 0.5, 0.3, 0.4, 0.3, 0.3, 0.5, -2.0, 0.3, 1.0, 0.0])
    if not rows:
        return tuple(prior)
    x = np.array([[1.0, *f] for f, _ in rows])
    y = np.array([v for _, v in rows], dtype=float)
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1.0 * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-8:
            break
    return tuple(w.tolist())


def scored(rows: DataFrame, weights: tuple[float, ...], *, least: float = 0.5) -> DataFrame:
    """Rows of ``described`` with ``score`` (0 to 1) and ``predicted`` (1 from ``least`` on), without the features.

    A text without a hit, an empty one too, gets the score of the bias. Equal texts get equal scores.
    """
    z = F.lit(weights[0])
    for i, w in enumerate(weights[1:]):
        z = z + F.col("features")[i] * F.lit(w)
    out = rows.withColumn("score", 1 / (1 + F.exp(-z))).drop("features")
    return out.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
