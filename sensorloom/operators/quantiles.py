"""Exact, linearly interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here a group
is searched like a radix tree: a coarse cell histogram finds the cell of each
wanted rank, only the values of that cell are split again, and the last step
orders at most 2^18 distinct values.

A stored table is scanned once per level and only histograms are shuffled. A
derived table is reduced to value counts, which are shuffled once and shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.names import col
from sensorloom.sources.sinks import settle

_FINE, _COARSE = 34, 22  # bits below the leading one; the coarse cell drops 22 of them
_BROADCAST_ROWS = 100_000  # rank requests are under 100 bytes each


def _cell(v: Column) -> Column:
    """Integer that grows with the double: sign, exponent, leading mantissa bits."""
    size = F.abs(v)
    power = F.least(F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-1022)), F.lit(1023))
    lead = F.floor(size / F.pow(F.lit(2.0), power) * F.lit(float(1 << _FINE)))
    code = (power + 1030) * F.lit(1 << (_FINE + 1)) + lead
    code = F.when(size == float("inf"), F.lit(2100 << (_FINE + 1))).otherwise(code)
    code = F.when(size == 0, F.lit(0)).when(v < 0, -code).otherwise(code).cast("long")
    return F.coalesce(code, F.lit(0).cast("long"))


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    *,
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    stored: bool = False,
    overall: str | None = None,
) -> DataFrame:
    """One row per group with a column per probability. Null values and null groups are left out.

    With ``overall`` a row for the whole table follows, null groups included: its keys are null and the boolean column
    of that name is true. Its histogram is the sum of those of the groups; beyond that, rows count twice only in
    the cells that hold one of its ranks.

    Set ``stored`` when ``df`` is a cheap scan: the two rank tables are then made
    first (small jobs), and broadcast if their counted size allows.

    Otherwise all is lazy. The filters are spelled out and the cell is never null, so every level reads the
    same shuffled value counts instead of its own copy.
    """
    names = list(names or [f"q{i}" for i in range(len(probs))])
    group = [col(k) for k in by]
    counts = df.select(*group, col(value).cast("double").alias("__v")).dropna(
        subset=["__v", *([] if overall else [f"`{k}`" for k in by])]
    )
    if stored:
        counts = counts.withColumn("__n", F.lit(1).cast("long"))
    else:
        counts = counts.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__n"))

    def ranks(t: DataFrame) -> DataFrame:
        if not stored:
            return t
        t = settle(t)
        return F.broadcast(t) if t.count() <= _BROADCAST_ROWS else t

    coded = counts.withColumn("__fine", _cell(F.col("__v"))).withColumn(
        "__cell", F.shiftright(F.col("__fine"), _COARSE)
    )

    def own_or_none() -> list[Column]:
        return [F.when(~F.col("__all"), col(k)).alias(k) for k in by]

    def met(t: DataFrame, wanted: DataFrame, at: str) -> DataFrame:
        """The rows of ``t`` in the wanted cells of their group, and of the whole table."""
        if not overall:
            return t.join(wanted, [*by, at])
        # two cells a probability
        near = F.broadcast(wanted.where("__all").select(at, F.lit(True).alias("__near")).distinct())
        twice = F.when(F.col("__near"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        t = t.join(near, at, "left").withColumn("__all", F.explode(twice))
        t = t.select(*own_or_none(), *[c for c in t.columns if c not in by])
        keys = [*by, "__all", at]
        right = wanted.withColumnsRenamed({k: f"__want{i}" for i, k in enumerate(keys)})
        same = [col(k).eqNullSafe(F.col(f"__want{i}")) for i, k in enumerate(keys)]
        return t.join(right, same).drop(*[f"__want{i}" for i in range(len(keys))])

    # level 1: histogram of coarse cells, then the cell of each wanted rank
    hist = coded.groupBy(*group, "__cell").agg(F.sum("__n").alias("__n"))
    if overall:
        hist = hist.withColumn("__all", F.explode(F.array(F.lit(False), F.lit(True))))
        for k in by:
            hist = hist.where(F.col("__all") | col(k).isNotNull())
        hist = hist.groupBy(*own_or_none(), "__all", "__cell").agg(F.sum("__n").alias("__n"))
        group = [*group, F.col("__all")]
    everything = Window.partitionBy(*group)
    hist = hist.withColumn("__cum", F.sum("__n").over(everything.orderBy("__cell"))).withColumn(
        "__total", F.sum("__n").over(everything)
    )
    asks = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.lit(up).alias("up"))
                for i, p in enumerate(probs)
                for up in (False, True)
            ]
        )
    )
    place = (F.col("__total") - 1) * F.col("__ask.p")
    wanted = (
        hist.withColumn("__ask", asks)
        .withColumn("__rank", F.when(F.col("__ask.up"), F.ceil(place)).otherwise(F.floor(place)))
        .withColumn("__share", place - F.floor(place))
    )
    hit = (F.col("__rank") < F.col("__cum")) & (F.col("__rank") >= F.col("__cum") - F.col("__n"))
    keep = [*group, F.col("__ask.i").alias("__i"), F.col("__ask.up").alias("__up"), "__share"]
    rest = (F.col("__rank") - (F.col("__cum") - F.col("__n"))).alias("__rank")
    wanted = ranks(wanted.where(hit).select(*keep, rest, "__cell"))

    # level 2: only values of the wanted cells, split by fine cell
    ask = [*by, *(["__all"] if overall else []), "__i", "__up"]
    part = Window.partitionBy(*[col(k) for k in ask])
    fine = met(coded, wanted, "__cell").groupBy(*[col(k) for k in ask], "__share", "__rank", "__fine")
    fine = fine.agg(F.sum("__n").alias("__n")).withColumn("__cum", F.sum("__n").over(part.orderBy("__fine")))
    narrowed = ranks(fine.where(hit).select(*[col(k) for k in ask], "__share", rest, "__fine"))

    # leaf: order the few values that are left
    leaf = met(coded.select(*[col(k) for k in by], "__fine", "__v", "__n"), narrowed, "__fine")
    leaf = leaf.groupBy(*[col(k) for k in ask], "__share", "__rank", "__v").agg(F.sum("__n").alias("__n"))
    leaf = leaf.withColumn("__cum", F.sum("__n").over(part.orderBy("__v"))).where(hit)

    def side(i: int, up: bool) -> Column:
        return F.max(F.when((F.col("__i") == i) & (F.col("__up") == up), F.col("__v")))

    def at(i: int) -> Column:
        share = F.max(F.when(F.col("__i") == i, F.col("__share")))
        return (F.lit(1.0) - share) * side(i, False) + share * side(i, True)

    found = leaf.groupBy(*group).agg(*[at(i).alias(n) for i, n in enumerate(names)])
    return found.withColumnRenamed("__all", overall) if overall else found


def sorted_quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    *,
    by: Sequence[str],
    names: Sequence[str],
    count: str | None = None,
) -> DataFrame:
    """Exact quantiles of many groups that each hold a small share of the rows.

    One exchange and one spilling sort per group; groups without a value stay, with
    nulls. For few, large groups use ``exact_quantiles``.
    """
    part = Window.partitionBy(*[col(k) for k in by])
    v = col(value).cast("double")
    ranked = df.select(
        *[col(k) for k in by],
        v.alias("__v"),
        F.row_number().over(part.orderBy(v.asc_nulls_last())).alias("__row"),
        F.count(v).over(part).alias("__total"),
    )

    def at(p: float) -> Column:
        place = (F.col("__total") - 1) * F.lit(float(p))
        low = F.max(F.when(F.col("__row") - 1 == F.floor(place), F.col("__v")))
        high = F.max(F.when(F.col("__row") - 1 == F.ceil(place), F.col("__v")))
        share = F.max(place - F.floor(place))
        return (F.lit(1.0) - share) * low + share * high

    extra = [F.max("__total").alias(count)] if count else []
    return ranked.groupBy(*[col(k) for k in by]).agg(*[at(p).alias(n) for n, p in zip(names, probs, strict=True)], *extra)
