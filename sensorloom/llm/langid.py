"""Language identification by cross-parsing: how few phrases of a language's own text make up a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from sensorloom.functions.names import col
from sensorloom.llm.common import fresh, slices, texts, with_columns, without

UNKNOWN = "und"
#: Labelled text per language: documents of at most ``DOC_CHARS`` characters, then the beginnings of longer ones, until
#: ``LANG_CHARS`` are reached.
LANG_CHARS, DOC_CHARS = 24_000, 4_000
#: Documents are parsed in blocks of this many characters; a phrase ends with its block.
BLOCK = 512
_OTHER = 0  # symbol code of anything that no training text holds


@dataclass(frozen=True)
class Samples:
    """Training text per language, small by its two limits; tasks get it as it is and build automata from it."""

    langs: tuple[str, ...]
    texts: tuple[str, ...]


def learn(docs: DataFrame, usable: Column, *, text: str = "text", lang: str = "lang") -> Samples:
    """Draw the training text: distinct texts of documents where ``usable``, in the order of a hash of the text.

    Whole documents come first. Where those of a language don't fill ``LANG_CHARS``, the first ``DOC_CHARS`` characters
    of its longer ones follow, so each language with a labelled text is learned. Counts of distinct texts set a hash
    threshold, so that about a thousand rows per language reach the ranking; copies share a hash and are merged.
    """
    given = col(text).cast("string")
    piece = F.substring(given, 1, DOC_CHARS)
    labelled = docs.where(usable & col(lang).isNotNull() & (F.length(given) >= 1)).select(
        col(lang).cast("string").alias("lang"),
        (F.length(given) > DOC_CHARS).alias("long"),
        F.xxhash64(piece).alias("h"),
        piece.alias("text"),
        F.length(piece).alias("n"),
    )
    distinct = labelled.groupBy("lang", "long", "h").agg(F.max("n").alias("n"))
    counts = distinct.groupBy("lang", "long").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_chars")).collect()
    whole = {r.lang: r.n_chars for r in counts if not r.long}
    shares = [
        (r.lang, r.long, min(1.0, 4.0 * LANG_CHARS / r.n_chars + 64.0 / r.n_rows))
        for r in counts
        if not r.long or whole.get(r.lang, 0) < LANG_CHARS
    ]
    # a row or two per language, of which the driver will hold the training text anyway
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, long boolean, share double"))
    drawn = labelled.join(share, ["lang", "long"]).where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    drawn = drawn.select("lang", "long", "h", "text", "n").distinct()
    by_hash = Window.partitionBy("lang").orderBy("long", "h", "text")
    before = F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, -1))
    chosen = drawn.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < LANG_CHARS)
    rows = chosen.orderBy("lang", "long", "h", "text").select("lang", "text").collect()
    langs = sorted({r.lang for r in rows})
    return Samples(tuple(langs), tuple("\n".join(r.text for r in rows if r.lang == g) for g in langs))


# ------------------------------------------------------------------ automata
_WORDS = np.zeros(1 << 16, dtype=bool)
for _c in range(1 << 16):
    _WORDS[_c] = chr(_c).isalpha() or chr(_c) in "'’" or 0x300 <= _c < 0x370


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points; each run of anything else is one blank. Letters past U+FFFF count as U+FFFF."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = np.ones(len(points), dtype=bool)
    low = points < 1 << 16
    word[low] = _WORDS[points[low]]
    points = np.where(word, np.minimum(points, 0xFFFF), 32)
    return points[word | np.append(True, word[:-1])] if len(points) else points


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Steps of each state of the suffix automaton of coded text: symbol to next state. State 0 is the root."""
    links, lengths, step, last = [-1], [0], [{}], 0
    for c in text.tolist():
        here = len(step)
        lengths.append(lengths[last] + 1)
        step.append({})
        links.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = here
            p = links[p]
        if p >= 0:
            q = step[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[here] = q
            else:
                copy = len(step)
                lengths.append(lengths[p] + 1)
                step.append(dict(step[q]))
                links.append(links[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = links[p]
                links[q] = links[here] = copy
        last = here
    return step


def packed(steps: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(base, owner, target)``: all steps in one row of cells, those of a state laid into the gaps between others'.

    The step of state ``s`` by symbol ``c`` is in cell ``base[s] + c``, if the owner of that cell is ``s``. Cells are about as
    many as steps, whatever the number of symbols. States with many steps are placed first.
    """
    taken = bytearray(2 * width)
    base = np.zeros(len(steps), dtype=np.int32)
    begin: dict[int, int] = {}  # where the search for states with as many steps goes on
    for s in sorted((s for s, out in enumerate(steps) if out), key=lambda s: -len(steps[s])):
        out = sorted(steps[s])
        rest = [c - out[0] for c in out[1:]]
        cell = begin.get(len(out), -1)
        while True:
            cell = taken.find(0, cell + 1)
            if cell < 0 or cell + width >= len(taken):
                cell = len(taken) if cell < 0 else cell
                taken.extend(bytes(len(taken)))
            if not any(taken[cell + r] for r in rest):
                break
        begin[len(out)] = cell
        base[s] = cell - out[0] + width  # cells are moved by a width, so no base is negative
        taken[cell] = 1
        for r in rest:
            taken[cell + r] = 1
    size = int(base.max(initial=0)) + width + 1
    owner, target = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
    for s, out in enumerate(steps):
        for c, to in out.items():
            owner[base[s] + c], target[base[s] + c] = s, to
    return base, owner, target


class Parser:
    """Counts phrases of many blocks of text at once, in all languages.

    A phrase is the longest run of symbols, from where the last one ended, that the training text holds; a symbol that it
    doesn't hold is a phrase of its own. Steps of the automata are stored sparsely (``packed``), so a language of many
    letters takes no more memory than one of few.
    """

    def __init__(self, samples: Samples):
        coded = [symbols(t) for t in samples.texts]
        seen = np.unique(np.concatenate(coded)) if coded else np.array([], dtype=np.uint32)
        width = len(seen) + 1
        self.langs = samples.langs
        self.code = np.full(1 << 16, _OTHER, dtype=np.uint16)
        self.code[seen] = np.arange(1, width, dtype=np.uint16)
        # one price for a phrase in all languages: with its own length a language with little text would look cheap
        self.bits = float(np.log2(max([2, *map(len, coded)])))
        self.tables = []
        for c in coded:
            steps = suffix_automaton(self.code[c])
            # where a phrase ends, the next one starts at the root; a symbol without a step there is a phrase too
            first = np.zeros(width, dtype=np.int32)
            first[list(steps[0])] = list(steps[0].values())
            self.tables.append((*packed(steps, width), first, np.where(first > 0, 1, 2).astype(np.int32)))

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """``[document, language]`` counts."""
        n_blocks = np.array([-(-len(d) // BLOCK) for d in docs], dtype=np.int64)
        total = int(n_blocks.sum())
        counts = np.zeros((len(docs), len(self.langs)), dtype=np.int64)
        if not total or not self.langs:
            return counts
        grid = np.zeros(total * BLOCK, dtype=np.uint16)
        firsts = np.concatenate([[0], np.cumsum(n_blocks)[:-1]])
        sizes = np.full(total, BLOCK, dtype=np.int64)
        for d, f, n in zip(docs, firsts, n_blocks):
            grid[f * BLOCK : f * BLOCK + len(d)] = self.code[d]
            if n:
                sizes[f + n - 1] = len(d) - (n - 1) * BLOCK
        longest = np.argsort(-sizes, kind="stable")
        columns = np.ascontiguousarray(grid.reshape(total, BLOCK)[longest].T)
        active = total - np.searchsorted(np.sort(sizes), np.arange(BLOCK), side="right")  # blocks longer than a position
        owners = np.repeat(np.arange(len(docs)), n_blocks)[longest]
        for k, (base, owner, target, first, price) in enumerate(self.tables):
            state = np.zeros(total, dtype=np.int32)
            ended = np.zeros(total, dtype=np.int32)
            for n, column in zip(active.tolist(), columns):
                if not n:
                    break
                here, symbol = state[:n], column[:n]
                cell = base[here] + symbol
                to = target[cell]
                stop = np.flatnonzero(owner[cell] != here)
                if len(stop):
                    c = symbol[stop]
                    ended[stop] += price[c] - (here[stop] == 0)  # no phrase is open at the root
                    to[stop] = first[c]
                state[:n] = to
            ended += state != 0
            counts[:, k] = np.bincount(owners, weights=ended, minlength=len(docs)).astype(np.int64)
        return counts

    def decide(self, docs: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score; the score is the share of the winner in the sum of 2 to the minus code length."""
        coded = [symbols(t) for t in docs]
        lettered = [bool(len(c)) and any(ch.isalpha() for ch in t) for c, t in zip(coded, docs)]
        if not self.langs:
            return [UNKNOWN] * len(docs), np.zeros(len(docs))
        cost = self.phrases(coded) * self.bits
        best = cost.argmin(axis=1)  # ties: the first in the order of names
        gap = np.minimum(cost - cost.min(axis=1, keepdims=True), 1000.0)
        score = np.where(lettered, 1.0 / np.exp2(-gap).sum(axis=1), 0.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score


@lru_cache(maxsize=1)
def parser(samples: Samples) -> Parser:
    return Parser(samples)


# ----------------------------------------------------------------- operators
def identify(docs: DataFrame, samples: Samples, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all), ``lang_pred`` and ``score`` (0 to 1) from the text alone.

    A text that is null or holds no letter is ``und`` with score 0; so is every text if no labelled text was given. Equal
    texts get equal results; ties go to the first language by name. Blocks of one batch are parsed side by side, so a
    very long text costs no more than as many short ones. No row gives no row. Columns named ``lang_pred`` or ``score``
    give way to the new ones.
    """
    carried = fresh(docs, "lang_text")
    kept = without(docs.select(*[col(c) for c in (docs.columns if keep is None else keep)]), "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for part in slices(batches, carried):
            known = known or parser(samples)
            langs, score = known.decide(texts(part, carried))
            yield with_columns(part, {carried}, lang_pred=pa.array(langs, type=pa.string()), score=pa.array(score))

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    given = docs.select(*[col(c) for c in kept.columns], col(text).cast("string").alias(carried))
    return given.mapInArrow(run, schema)


def accept(docs: DataFrame, samples: Samples, *, text: str = "text", lang: str = "lang", least_score: float = 0.3) -> DataFrame:
    """Documents with a language, all columns; ``lang`` becomes the predicted one.

    Rejected are texts without a letter and those whose winner has a score below ``least_score``.
    """
    inner = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], col(text).alias("given_text"))
    keep = [f"c{i}" for i in range(len(docs.columns))]
    found = identify(inner, samples, text="given_text", keep=keep)
    good = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return good.select(
        *[(F.col("lang_pred") if c == lang else F.col(k)).alias(c) for k, c in zip(keep, docs.columns)]
    )
