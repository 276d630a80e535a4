"""Mixing sources to target weights: token blocks, multinomial counts per shard, permuted block indices, one join."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from sensorloom.functions.names import col
from sensorloom.llm.common import durable, fresh, raw, slices, with_columns

WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in code point order, a null source last."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5  # of all words
    repeat: int = 2  # how often a word may be taken
    block: int = 128  # words
    shard: int = 4096  # slots of one output shard
    seed: int = 7


# ------------------------------------------------------------------- streams
def sized(docs: DataFrame, name: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) and the number of words of the text (null: 0)."""
    carried = fresh(docs, "size_text")
    kept = [col(c) for c in (docs.columns if keep is None else keep)]
    base = docs.select(*kept, col(text).cast("string").alias(carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, carried):
            n = pa.array([len(t.split()) for t in raw(part, carried)], type=pa.int64())
            yield with_columns(part, {carried}, **{name: n})

    schema = StructType([*base.schema.fields[:-1], StructField(name, LongType())])
    return base.mapInArrow(run, schema)


def in_streams(rows: DataFrame, source: str, size: str, order: list[Column], spread: int) -> DataFrame:
    """Add ``stream_at``: where a row's words begin in the stream of its source.

    A prefix sum in two steps: rows are spread over ``spread`` buckets by a hash, so that a large source is many
    groups; sums per (source, bucket) give each bucket its start.
    """
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(spread)))
    sums = bucketed.groupBy(source, "bucket").agg(F.sum(size).alias("words"))
    by_bucket = Window.partitionBy(source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(source).alias("s_source"),
        F.col("bucket").alias("s_bucket"),
        F.coalesce(F.sum("words").over(by_bucket), F.lit(0)).alias("bucket_at"),
    )
    inside = Window.partitionBy(source, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("inner_at", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = placed[source].eqNullSafe(starts.s_source) & (placed.bucket == starts.s_bucket)
    return (
        placed.join(starts, same)
        .withColumn("stream_at", F.col("bucket_at") + F.col("inner_at"))
        .drop("s_source", "s_bucket", "bucket_at", "inner_at", "bucket")
    )


# ------------------------------------------------------------------- targets
def targets(sizes: DataFrame, mix: Mix, source: str = "source") -> DataFrame:
    """``(source, source_no, source_size, target)``, a row per source.

    Shares are by weight; where a share is above ``repeat`` times the source's size it stops there and the rest is
    shared again, until none is above. In the order of cap over weight the stopped sources are a prefix, so one running
    sum over the source table finds them.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("source_no") % len(mix.weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source))
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(mix.repeat))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    upto = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        mix.share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("stopped", F.col("level") * F.col("weight") >= F.col("cap"))
    free_level = F.first(F.when(~F.col("stopped"), F.col("level")), ignorenulls=True).over(
        by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.least(F.col("cap"), F.coalesce(free_level, F.lit(float("inf"))) * F.col("weight"))
    return per.withColumn("target", share).select(source, "source_no", "source_size", "target")


# --------------------------------------------------------------------- slots
@dataclass(frozen=True)
class Plan:
    """Slots of each source: all its blocks ``rounds`` times, then ``full`` blocks and ``rest`` words of one more.

    A source's last block may be short; it comes last in each round, so a mix holds exactly the target, rounded.
    """

    names: tuple[int, ...]
    sizes: tuple[int, ...]
    goals: tuple[int, ...]
    block: int

    def __post_init__(self):
        size, goal = np.array(self.sizes, dtype=np.int64), np.array(self.goals, dtype=np.int64)
        whole, tail = size // self.block, (size % self.block > 0).astype(np.int64)
        rounds = np.where(size > 0, goal // np.maximum(size, 1), 0)
        rest = goal - rounds * size
        slots = rounds * (whole + tail) + -(-rest // self.block)
        for k, v in (("whole", whole), ("per_round", whole + tail), ("slots", np.where(size > 0, slots, 0))):
            object.__setattr__(self, k, v)


def _shard_counts(plan: Plan, shard: int, shards: int, per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one shard, and before it.

    A binary tree over the shards: at each node a multinomial draw by the slots still to place says how many of each
    source go left. A draw above what a source has left goes to the others. So every shard finds its own counts by
    itself in logarithmic time, they are the same on each run, and over all shards they add up to the plan.
    """
    left, have = np.zeros(len(plan.names), dtype=np.int64), plan.slots.copy()
    a, b = 0, shards
    while b - a > 1:
        mid = (a + b) // 2
        room = min(int(have.sum()), (mid - a) * per_shard)
        draw = np.random.default_rng([seed, a, b]).multinomial(room, have / max(have.sum(), 1)) if room else np.zeros_like(have)
        draw = np.minimum(draw, have)
        missing = room - int(draw.sum())
        for k in np.argsort(-(have - draw), kind="stable") if missing else ():
            more = min(missing, int(have[k] - draw[k]))
            draw[k] += more
            missing -= more
        if shard < mid:
            have, b = draw, mid
        else:
            left, have, a = left + draw, have - draw, mid
    return have, left


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 to n-1: four Feistel rounds, walked until the result is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        lo, hi = x & mask, x >> shift
        for r in range(4):
            f = (lo + np.uint64((key * 4 + r) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            lo, hi = (hi ^ (f >> np.uint64(32))) & mask, lo
        x = hi << shift | lo
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


#: Rows of a list of repeated rows that are sent to every task.
SENT = 500_000
SLOTS = "source_no int, block_no long, round int, take long, shard long, slot long"


def slots(spark, plan: Plan, mix: Mix) -> DataFrame:
    """One row per slot of the mix: which block of which source it takes, in which round, and how many words of it."""
    shards = max(1, -(-int(plan.slots.sum()) // mix.shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                counts, before = _shard_counts(plan, shard, shards, mix.shard, mix.seed)
                mixed = np.random.default_rng([mix.seed, 3, shard]).permutation(int(counts.sum()))
                at = 0
                for k, n in enumerate(counts.tolist()):
                    if not n:
                        continue
                    j = np.arange(before[k], before[k] + n, dtype=np.int64)
                    turn, idx = np.divmod(j, plan.per_round[k])
                    block = idx.copy()
                    for t in np.unique(turn).tolist():
                        here = (turn == t) & (idx < plan.whole[k])
                        block[here] = permuted(idx[here], int(plan.whole[k]), mix.seed * 1000 + plan.names[k] * 8 + t)
                    take = np.full(n, mix.block, dtype=np.int64)
                    done = turn * plan.sizes[k] + idx * mix.block
                    take = np.maximum(0, np.minimum(take, plan.goals[k] - done))
                    cols = [np.full(n, plan.names[k], np.int32), block, turn.astype(np.int32), take, np.full(n, shard, np.int64), mixed[at : at + n]]
                    at += n
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in SLOTS.split(", ")])

    tasks = min(shards, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, shards, 1, tasks).mapInArrow(run, SLOTS)


# ---------------------------------------------------------------- the mixture
def mixture(docs: DataFrame, mix: Mix, *, doc_id: str, source: str, text: str, row: Column | None = None):
    """``(rows, taken)``: rows with their place in the streams and their source's target, and what the mix takes.

    ``rows`` has ``m_id, m_source, size, m_no, stream_at, source_size, target`` and, if ``row`` is given, its value as
    ``m_row``; ``taken`` has ``t_no, t_at, round, first, words, shard, slot``: words ``first`` on of the row at ``(t_no, t_at)``.
    Texts are read once, for their numbers of words.
    """
    named = [] if row is None else ["m_row"]
    base = docs.select(
        *([] if row is None else [row.alias("m_row")]),
        col(doc_id).alias("m_id"),
        col(source).alias("m_source"),
        col(text).cast("string").alias("m_text"),
        F.xxhash64(col(text).cast("string")).alias("m_hash"),
    )
    narrow = durable(sized(base, "size", text="m_text", keep=[*named, "m_id", "m_source", "m_hash"]))
    table = targets(narrow.withColumnRenamed("m_source", "source"), mix).collect()  # a row per source to be weighed
    plan = Plan(
        tuple(r.source_no for r in table),
        tuple(int(r.source_size) for r in table),
        tuple(int(r.target + 0.5) for r in table),
        mix.block,
    )
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(r.source, r.source_no, int(r.source_size), float(r.target)) for r in table],
        StructType(
            [
                StructField("s_source", docs.schema[source].dataType),
                StructField("m_no", IntegerType()),
                StructField("source_size", LongType()),
                StructField("target", DoubleType()),
            ]
        ),
    )
    if len(table) <= 10_000:
        known = F.broadcast(known)
    spread = 32 + sum(plan.sizes) // 4_000_000
    order = [F.col("m_id"), F.col("size"), F.col("m_hash")]

    def placed(rows: DataFrame) -> DataFrame:
        at = in_streams(rows, "m_source", "size", order, spread)
        return at.join(known, at.m_source.eqNullSafe(known.s_source)).drop("s_source")

    # equal rows may change places between evaluations, which changes nothing: the places are the same
    rows = placed(narrow)
    streams = rows.where("size > 0")
    touched = streams.select(
        "m_no",
        "stream_at",
        "size",
        F.explode(F.sequence(F.floor(F.col("stream_at") / mix.block), F.floor((F.col("stream_at") + F.col("size") - 1) / mix.block))).alias("b"),
    )
    lo = F.greatest(F.col("stream_at"), F.col("b") * mix.block)
    hi = F.least(F.col("stream_at") + F.col("size"), (F.col("b") + 1) * mix.block)
    pieces = touched.select("m_no", "b", "stream_at", (lo - F.col("b") * mix.block).alias("in_block"), (lo - F.col("stream_at")).alias("first"), (hi - lo).alias("n"))
    drawn = slots(spark, plan, mix)
    # the size of the slot table is known only when it is made, so it is never planned as a small side
    met = pieces.join(drawn.hint("merge"), (pieces.m_no == drawn.source_no) & (pieces.b == drawn.block_no))
    words = F.least(F.col("n"), F.col("take") - F.col("in_block"))
    taken = met.where("take > in_block").select(
        F.col("m_no").alias("t_no"), F.col("stream_at").alias("t_at"), "round", "first", words.alias("words"), "shard", "slot"
    )
    return rows, taken


def taken_words(docs: DataFrame, mix: Mix | None = None, *, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of each row: the words of it that the mix takes, repeats counted.

    A null text has size 0 and nothing is taken; null sources are one source, the last; equal rows are separate rows of
    the stream; a null id stays null; an empty table gives an empty result. Each source gives its target to the word,
    and no row more than ``repeat`` times its size, since a round takes each block once at most.
    """
    rows, taken = mixture(docs, mix or Mix(), doc_id=doc_id, source=source, text=text)
    zero = F.lit(0).cast("long")
    each = rows.select("m_id", "size", "source_size", "target", "m_no", "stream_at", zero.alias("words"), F.lit(True).alias("own"))
    filled = each.where("size > 0").select("m_no", "stream_at", "m_id", "size", "source_size", "target", "words", "own")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("m_id", docs.schema[doc_id].dataType), ("size", "long"), ("source_size", "long"), ("target", "double"))]
    drawn = taken.select(F.col("t_no").alias("m_no"), F.col("t_at").alias("stream_at"), *none, "words", F.lit(False).alias("own"))
    summed = filled.unionByName(drawn).groupBy("m_no", "stream_at").agg(
        *[F.first(F.when(F.col("own"), F.col(c)), ignorenulls=True).alias(c) for c in ("m_id", "size", "source_size", "target")],
        F.sum("words").alias("taken"),
    )
    out = [F.col("m_id").alias("doc_id"), "size", "source_size", "target", "taken"]
    return summed.select(*out).unionByName(each.where("size = 0").select(*out[:4], F.col("words").alias("taken")))


def mixed(
    docs: DataFrame,
    mix: Mix | None = None,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: str | None = None,
) -> DataFrame:
    """The mix as rows of ``docs``: for each round, what it takes of a document, as one text in the order of the document.

    Where the mix takes a whole document its text is unchanged; otherwise it is the taken runs of words with the blanks
    between them, runs parted by a line feed. A document taken twice gives two rows; one not taken gives none. ``size``
    may name a column for the length of the text.
    """
    whole = F.xxhash64(*[col(c) for c in docs.columns], F.lit(mix.seed if mix else 0))
    rows, taken = mixture(docs, mix or Mix(), doc_id=doc_id, source=source, text=text, row=whole)
    runs = taken.groupBy("t_no", "t_at", "round").agg(
        F.array_sort(F.collect_list(F.struct("first", "words"))).alias("runs")
    )
    worded = rows.where("size > 0")  # a row without words begins where the next one does
    met = worded.join(runs, (worded.m_no == runs.t_no) & (worded.stream_at == runs.t_at)).select("m_id", "m_row", "size", "runs")
    # texts are shuffled once, to what is taken of them; equal rows stand for each other, so one of them meets all
    given = docs.select(*[col(c).alias(f"k_{c}") for c in docs.columns], col(doc_id).alias("g_id"), whole.alias("g_row"))
    again = durable(worded.groupBy("m_id", "m_row").count().where("count > 1").select(F.col("m_id").alias("a_id"), F.col("m_row").alias("a_row")))
    if not again.isEmpty():
        sent = F.broadcast(again) if again.count() <= SENT else again
        same = given.g_id.eqNullSafe(again.a_id) & (given.g_row == again.a_row)
        twice = given.join(sent, same, "left_semi").dropDuplicates(["g_id", "g_row"])
        given = given.join(sent, same, "left_anti").unionByName(twice)
    body = f"k_{text}"
    given = given.join(met, given.g_id.eqNullSafe(met.m_id) & (given.g_row == met.m_row)).select(
        *[F.col(f"k_{c}") for c in docs.columns],
        F.transform("runs", lambda r: r["first"]).alias("r_first"),
        F.transform("runs", lambda r: r["words"]).alias("r_words"),
        F.col("size").alias("r_size"),
    )
    names = [f"k_{c}" for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, body):
            out, columns = [], (raw(part, body), part.column("r_first").to_pylist(), part.column("r_words").to_pylist(), part.column("r_size").to_pylist())
            for t, first, words, n in zip(*columns):
                if sum(words) == n:
                    out.append(t)
                    continue
                ends: list[list[int]] = []
                for f, w in zip(first, words):
                    if ends and ends[-1][1] == f:
                        ends[-1][1] = f + w
                    else:
                        ends.append([f, f + w])
                at = [m.span() for m in WORD.finditer(t)]
                out.append(b"\n".join(t[at[a][0] : at[b - 1][1]] for a, b in ends))
            texts = pa.array(out, type=pa.binary()).cast(part.column(body).type)
            cols = [texts if c == body else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = StructType([f for f in given.schema.fields if f.name in names])
    done = given.mapInArrow(run, schema)
    return done.select(
        *[
            (F.length(F.col(body)).cast(docs.schema[c].dataType) if c == size else F.col(f"k_{c}")).alias(c)
            for c in docs.columns
        ]
    )
