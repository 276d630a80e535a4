"""Time windows that never gather a whole series in one task.

Every operator here partitions on ``(keys, time bucket)``:

* a *halo* copies the rows near a bucket edge into the neighbour bucket, so a
  bounded frame sees its full width inside one partition;
* a *carry* aggregates one row per bucket, runs the unbounded window over
  those summaries (one row per key and bucket) and joins the result back;
* *rolling_stats* splits a long frame into the tail of one block and the head
  of the next, so its cost does not depend on the frame width.

Key columns must be non-null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorloom.functions.names import col
from sensorloom.functions.timekit import bucket_no, second_in_bucket

DAY = 1440
_B, _OWN = "__bucket", "__own"


def _cols(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def with_halo(
    df: DataFrame,
    ts: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    *,
    keys: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    span: int | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before``/``after`` minutes.

    Rows must lie on a complete minute grid when frames count rows.
    """
    span = span or max(DAY, 2 * (before + after))
    if max(before, after) > span:
        raise ValueError("a halo cannot be wider than its bucket")
    own = bucket_no(ts, span)
    place = second_in_bucket(ts, span)
    copies = [own]
    if before:
        copies.append(F.when(place >= (span - before) * 60, own + 1))
    if after:
        copies.append(F.when(place < after * 60, own - 1))
    spread = F.explode(F.array_compact(F.array(*copies)))
    work = df.withColumn(_OWN, own).withColumn(_B, spread)
    w = Window.partitionBy(*_cols(keys), F.col(_B)).orderBy(col(ts))
    added = columns(w)
    names = [n for n in df.columns if n not in added]
    return (
        work.select(*_cols(names), _OWN, _B, *[c.alias(n) for n, c in added.items()])
        .where(F.col(_B) == F.col(_OWN))
        .drop(_B, _OWN)
    )


def carry(
    df: DataFrame,
    ts: str,
    *,
    last: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    keys: Sequence[str] = (),
    exclusive: bool = False,
    span: int = DAY,
) -> DataFrame:
    """Add, per row, the last (or next) non-null value of each expression.

    ``exclusive`` leaves the current row out. All expressions share one bucket
    summary and one join.
    """
    last, following = dict(last or {}), dict(following or {})
    exprs = {**last, **following}
    raw = {n: f"__raw_{i}" for i, n in enumerate(exprs)}
    work = df.withColumn(_B, bucket_no(ts, span)).withColumns({raw[n]: c for n, c in exprs.items()})
    when = col(ts)

    def edge(n: str) -> Column:
        stamp = F.when(F.col(raw[n]).isNotNull(), when)
        return F.max_by(F.col(raw[n]), stamp) if n in last else F.min_by(F.col(raw[n]), stamp)

    summary = work.groupBy(*_cols(keys), F.col(_B)).agg(*[edge(n).alias(raw[n]) for n in exprs])
    by_key = Window.partitionBy(*_cols(keys))
    ahead = by_key.orderBy(F.col(_B)).rowsBetween(Window.unboundedPreceding, -1)
    behind = by_key.orderBy(F.col(_B).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *_cols(keys),
        F.col(_B),
        *[
            F.last(F.col(raw[n]), ignorenulls=True).over(ahead if n in last else behind).alias(f"__far_{i}")
            for i, n in enumerate(exprs)
        ],
    )

    in_bucket = Window.partitionBy(*_cols(keys), F.col(_B))
    stop = -1 if exclusive else 0
    up = in_bucket.orderBy(when).rowsBetween(Window.unboundedPreceding, stop)
    down = in_bucket.orderBy(when.desc()).rowsBetween(Window.unboundedPreceding, stop)
    near = work.withColumns(
        {
            f"__near_{i}": F.last(F.col(raw[n]), ignorenulls=True).over(up if n in last else down)
            for i, n in enumerate(exprs)
        }
    )
    joined = near.join(carried, [*keys, _B], "left")
    names = [n for n in df.columns if n not in exprs]
    return joined.select(
        *_cols(names),
        *[F.coalesce(F.col(f"__near_{i}"), F.col(f"__far_{i}")).alias(n) for i, n in enumerate(exprs)],
    )


def forward_fill(
    df: DataFrame,
    ts: str,
    columns: Sequence[str],
    *,
    keys: Sequence[str] = (),
    default: float | None = None,
    span: int = DAY,
) -> DataFrame:
    """Carry the last value forward; rows before the first value get ``default``."""
    if not columns:
        return df
    out = carry(df, ts, last={c: col(c) for c in columns}, keys=keys, span=span)
    if default is not None:
        out = out.withColumns({c: F.coalesce(col(c), F.lit(default)) for c in columns})
    return out.select(_cols(df.columns))


def row_position(
    df: DataFrame,
    ts: str,
    *,
    keys: Sequence[str] = (),
    position: str = "position",
    total: str = "total",
    span: int = DAY,
    same_rows: DataFrame | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """0-based chronological position of each row, and the row count of its series.

    Rows of one time stand in the order of ``ties``.
    ``same_rows`` is an earlier table with the same keys and times; the bucket
    counts are then taken there instead of from the whole plan behind ``df``.
    """
    work = df.withColumn(_B, bucket_no(ts, span))
    counted = work if same_rows is None else same_rows.withColumn(_B, bucket_no(ts, span))
    counts = counted.groupBy(*_cols(keys), F.col(_B)).agg(F.count(F.lit(1)).alias("__n"))
    by_key = Window.partitionBy(*_cols(keys))
    ahead = by_key.orderBy(F.col(_B)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *_cols(keys),
        F.col(_B),
        F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset"),
        F.sum("__n").over(by_key).alias(total),
    )
    order = Window.partitionBy(*_cols(keys), F.col(_B)).orderBy(col(ts), *_cols(ties))
    numbered = work.withColumn("__row", F.row_number().over(order))
    return (
        numbered.join(offsets, [*keys, _B])
        .withColumn(position, F.col("__offset") + F.col("__row") - 1)
        .drop(_B, "__row", "__offset")
        .select(*_cols(df.columns), position, total)
    )


def chronological_split(
    df: DataFrame,
    ts: str,
    *,
    keys: Sequence[str] = (),
    train: float,
    validation: float,
    column: str = "split",
    span: int = DAY,
    same_rows: DataFrame | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """train / validation / test by position; the cuts are ``int(n * share)`` in doubles."""
    placed = row_position(
        df, ts, keys=keys, position="__pos", total="__total", span=span, same_rows=same_rows, ties=ties
    )
    n = F.col("__total").cast("double")
    return placed.withColumn(
        column,
        F.when(F.col("__pos") < F.floor(n * F.lit(train)), "train")
        .when(F.col("__pos") < F.floor(n * F.lit(validation)), "validation")
        .otherwise("test"),
    ).drop("__pos", "__total")


def rolling_stats(
    df: DataFrame,
    ts: str,
    value: str,
    window: int,
    *,
    keys: Sequence[str] = (),
    prefix: str = "roll_",
) -> DataFrame:
    """Count, mean and sample deviation over the last ``window`` grid rows.

    A frame of ``window`` rows ends in a block of that length and starts in the
    block before. Running aggregates from each block's start and toward each
    block's end are merged with the pairwise moment formulas, so the work per
    row is constant and nothing is subtracted from a running total.
    """
    own = bucket_no(ts, window)
    place = F.floor(second_in_bucket(ts, window) / 60)
    work = (
        df.withColumn(_OWN, own)
        .withColumn(_B, F.explode(F.array(own, own + 1)))
        .withColumn("__tail", F.col(_B) != F.col(_OWN))
        .withColumn("__place", place)
    )
    # one exchange serves the three windows below
    work = work.repartition(*_cols(keys), F.col(_B))
    part = [*_cols(keys), F.col(_B)]
    grow = Window.unboundedPreceding, 0
    up = Window.partitionBy(*part, F.col("__tail")).orderBy(col(ts)).rowsBetween(*grow)
    down = Window.partitionBy(*part, F.col("__tail")).orderBy(col(ts).desc()).rowsBetween(*grow)
    v = col(value).cast("double")
    head = F.struct(
        F.count(v).over(up).alias("n"),
        F.avg(v).over(up).alias("mean"),
        F.var_pop(v).over(up).alias("var"),
        F.min(v).over(up).alias("lo"),
        F.max(v).over(up).alias("hi"),
    )
    tail = F.when(
        F.col("__tail"),
        F.struct(
            F.count(v).over(down).alias("n"),
            F.avg(v).over(down).alias("mean"),
            F.var_pop(v).over(down).alias("var"),
            F.min(v).over(down).alias("lo"),
            F.max(v).over(down).alias("hi"),
        ),
    )
    work = work.withColumn("__a", tail).withColumn("__c", head)
    line = Window.partitionBy(*part).orderBy(col(ts))
    # the frame opens window - 1 rows back; a younger series opens at its first row
    opening = F.coalesce(
        F.lag("__a", window - 1).over(line) if window > 1 else F.lit(None),
        F.first("__a").over(line.rowsBetween(*grow)),
    )
    work = work.withColumn("__a", F.when(F.col("__place") < window - 1, opening)).where(~F.col("__tail"))

    an, cn = F.coalesce(F.col("__a.n"), F.lit(0)), F.col("__c.n")
    n = an + cn
    am, cm = F.coalesce(F.col("__a.mean"), F.col("__c.mean")), F.coalesce(F.col("__c.mean"), F.col("__a.mean"))
    av, cv = F.coalesce(F.col("__a.var"), F.lit(0.0)), F.coalesce(F.col("__c.var"), F.lit(0.0))
    m2 = av * an + cv * cn + (cm - am) * (cm - am) * an * cn / F.nullif(n, F.lit(0))
    flat = F.least(F.col("__a.lo"), F.col("__c.lo")) == F.greatest(F.col("__a.hi"), F.col("__c.hi"))
    return work.select(
        *_cols(df.columns),
        n.alias(f"{prefix}count"),
        ((am * an + cm * cn) / F.nullif(n, F.lit(0))).alias(f"{prefix}mean"),
        F.when(flat & (n > 1), F.lit(0.0)).otherwise(F.sqrt(m2 / F.nullif(n - 1, F.lit(0)))).alias(f"{prefix}sd"),
    )
