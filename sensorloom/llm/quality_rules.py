"""Quality rules with thresholds that follow each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from sensorloom.functions.names import col
from sensorloom.llm.common import BLANKS, fresh, raw, slices, with_columns, without

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A measure in thousandths and how far it may lie outside the middle half of its group.

    The fence is ``reach`` times the distance from median to quartile, at least ``floor``, beyond the quartile.
    """

    name: str
    part: str
    whole: str
    floor: int
    low: bool = False


RULES = (
    Rule("word_length", "word_chars", "n_words", 1000, low=True),
    Rule("symbols", "n_symbols", "n_words", 50),
    Rule("dup_lines", "n_dup_lines", "n_lines", 120),
    Rule("repeats", "n_repeat_words", "n_words", 120),
)
#: Groups with fewer documents take the sketch of their language, and languages with fewer that of all.
REACH, FEW = 3, 30
#: Leading binary digits that a sketch keeps of a value: quantiles are low by less than 1 part in 64.
DIGITS = 7


def measure(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one text. ``n_lines`` are the lines that hold a word."""
    words = text.split()
    filled = [line for line in text.split(b"\n") if line.split(None, 1)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0  # words before this position are counted
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    bare = text.translate(None, BLANKS)
    points = len(bare.decode("utf-8", "replace"))
    return len(words), points, len(text) - len(text.translate(None, SYMBOLS)), len(filled) - len(set(filled)), repeated, len(filled)


def measured(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) and ``COUNTS`` of the whole text (null: none of anything).

    A kept column with the name of a count gives way to it.
    """
    carried = fresh(docs, "rule_text")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in COUNTS]
    base = docs.select(*[col(c) for c in kept], col(text).cast("string").alias(carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, carried):
            rows = zip(*[measure(t) for t in raw(part, carried)])
            yield with_columns(part, {carried}, **{n: pa.array(r, type=pa.int64()) for n, r in zip(COUNTS, rows)})

    schema = StructType([*base.schema.fields[:-1], *[StructField(n, LongType()) for n in COUNTS]])
    return base.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thousandths(rule: Rule) -> Column:
    return F.coalesce(F.floor(1000 * F.col(rule.part) / F.nullif(F.col(rule.whole), F.lit(0))), F.lit(0)).cast("long")


def _bucket(value: Column) -> Column:
    """The value without its binary digits after the first ``DIGITS``."""
    extra = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.expr("0").cast("long") + F.call_function("shiftleft", F.call_function("shiftright", value, extra), extra)


def sketches(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """``(lang, source, rule, bucket, n)``: a histogram per group; those of two parts of the data add up."""
    long = rows.select(
        F.col(lang).alias("g_lang"),
        F.col(source).alias("g_source"),
        F.explode(
            F.array(*[F.struct(F.lit(r.name).alias("rule"), _bucket(thousandths(r)).alias("bucket")) for r in RULES])
        ).alias("m"),
    )
    return long.groupBy("g_lang", "g_source", "m.rule", "m.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bucket"))).alias(f"q{q}") for q in (1, 2, 3)]
    return ranked.groupBy(*keys, "rule").agg(*at, F.first("all").alias("rows"))


def fences(sketch: DataFrame) -> DataFrame:
    """``(g_lang, g_source, low_<rule>, high_<rule>)``, a row per group of the sketch."""
    floor = F.lit(None).cast("long")
    two_sided = F.lit(False)
    for r in RULES:
        floor = F.when(F.col("rule") == r.name, F.lit(r.floor).cast("long")).otherwise(floor)
        two_sided = F.when(F.col("rule") == r.name, F.lit(r.low)).otherwise(two_sided)

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c == "rule" else f"{tag}_{c}") for c in df.columns])

    own = _quartiles(sketch, ["g_lang", "g_source"])
    by_lang = named(_quartiles(sketch, ["g_lang"]), "l")
    overall = named(_quartiles(sketch, []), "a")
    met = own.join(by_lang, own.g_lang.eqNullSafe(by_lang.l_g_lang) & (own.rule == by_lang.rule), "left").drop(by_lang.rule)
    met = met.join(overall, "rule", "left")

    def pick(q: str) -> Column:
        return F.when(F.col("rows") >= FEW, F.col(q)).when(F.col("l_rows") >= FEW, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))

    got = met.select("g_lang", "g_source", "rule", floor.alias("floor"), two_sided.alias("two"), *[pick(f"q{i}").alias(f"q{i}") for i in (1, 2, 3)])
    high = F.col("q3") + REACH * F.greatest(F.col("q3") - F.col("q2"), F.col("floor"))
    low = F.when(F.col("two"), F.col("q1") - REACH * F.greatest(F.col("q2") - F.col("q1"), F.col("floor"))).otherwise(F.lit(-1))
    wide = [
        F.max(F.when(F.col("rule") == r.name, c)).alias(f"{side}_{r.name}") for r in RULES for side, c in (("low", low), ("high", high))
    ]
    return got.groupBy("g_lang", "g_source").agg(*wide)


def judged(rows: DataFrame, *, lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``measured`` with ``base_failed``, ``n_broken`` (fences broken) and ``kept``.

    ``rows`` is read twice, so pass a durable table. A row is kept if it passes the base rules and breaks no fence of its
    group. Null languages and sources are groups of their own; the values of a hot group meet in one sketch of a few
    hundred counts. An empty table gives an empty result. Columns with the names of the three new ones give way to them.
    """
    limits = fences(sketches(rows, lang, source))
    named = {c: fresh(rows, f"fence_{c}") for c in limits.columns}
    limits = limits.withColumnsRenamed(named)
    met = rows.join(limits, rows[lang].eqNullSafe(limits[named["g_lang"]]) & rows[source].eqNullSafe(limits[named["g_source"]]))

    def outside(r: Rule) -> Column:
        value = thousandths(r)
        return (value > F.col(named[f"high_{r.name}"])) | (value < F.col(named[f"low_{r.name}"]))

    n_broken = sum((F.when(outside(r), 1).otherwise(0) for r in RULES), F.lit(0)).cast("long")
    old = [col(c) for c in rows.columns if c.lower() not in ("base_failed", "n_broken", "kept")]
    out = met.select(*old, base_failed().alias("base_failed"), n_broken.alias("n_broken"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_broken") == 0))
