"""ON/OFF transitions and event studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import col, present
from sensorloom.operators.joins import around_events, to_long
from sensorloom.operators.quantiles import sorted_quantiles
from sensorloom.operators.windows import carry

METRICS = ["baseline", "post", "delta", "percent_change", "time_to_min", "persistence", "post_iqr"]


def transitions(
    df: DataFrame,
    ts: str,
    states: dict[str, str] | None = None,
    *,
    keys: Sequence[str] = (),
    include_first: bool = False,
    missing_is_off: bool = True,
) -> DataFrame:
    """``(keys, ts, chemical, event_type)`` for every change of every state, any row spacing.

    Default: steps of exactly one after NULL -> 0, the first row is no event. With
    ``include_first`` any change counts and the first row is an event of its state.
    """
    states = {k: v for k, v in (states or plant.STATES).items() if v in df.columns}
    if not states:
        raise ValueError("none of the state columns is present")
    now = {}
    for s, c in states.items():
        value = col(c).try_cast("double").cast("int")
        now[s] = F.coalesce(value, F.lit(0)) if missing_is_off else value
    slim = df.select(*[col(k) for k in keys], col(ts), *[v.alias(f"__s{i}") for i, v in enumerate(now.values())])
    # wrapped so that a NULL state of the previous row is told from no previous row
    boxed = {f"__p{i}": F.struct(F.col(f"__s{i}").alias("v")) for i in range(len(now))}
    both = carry(slim, ts, last=boxed, keys=keys, exclusive=True)
    kinds = []
    for i, s in enumerate(now):
        v, p = F.col(f"__s{i}"), F.col(f"__p{i}")
        if include_first:
            moved = p.isNull() | v.isNull() | p["v"].isNull() | (v != p["v"])
            kind = F.when(moved & (v == 1), "ON").when(moved & (v == 0), "OFF")
        else:
            kind = F.when(v - p["v"] == 1, "ON").when(v - p["v"] == -1, "OFF")
        kinds.append(F.struct(F.lit(s).alias("chemical"), kind.alias("event_type")))
    return (
        both.select(*[col(k) for k in keys], col(ts), F.explode(F.array(*kinds)).alias("__e"))
        .select(*[col(k) for k in keys], col(ts), "__e.chemical", "__e.event_type")
        .where(F.col("event_type").isNotNull())
    )


def event_counts(events: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    return events.groupBy(*[col(k) for k in keys], "chemical", "event_type").agg(F.count(F.lit(1)).alias("n"))


def first_transitions(events: DataFrame, ts: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Earliest transition of each kind; ``rank`` gives the display order (chemical, OFF before ON)."""
    return (
        events.groupBy(*[col(k) for k in keys], "chemical", "event_type")
        .agg(F.min(col(ts)).alias("first_ts"))
        .withColumn("label", F.concat_ws(" ", "chemical", "event_type"))
    )


def event_frames(
    df: DataFrame, ts: str, events: DataFrame, minutes: int = plant.WINDOW_MIN, *, keys: Sequence[str] = ()
) -> DataFrame:
    """All columns within ``±minutes`` of each event, with fractional ``minutes`` from it."""
    marks = events.withColumnRenamed(ts, "event_ts")
    return around_events(df, ts, marks, "event_ts", minutes, minutes, keys=keys, relative="minutes")


def aligned_signal(
    df: DataFrame,
    ts: str,
    events: DataFrame,
    signal: str,
    *,
    before: int = plant.STUDY_MIN,
    after: int = plant.STUDY_MIN,
    keys: Sequence[str] = (),
    drop_missing: bool = False,
) -> DataFrame:
    """``(event, rel_min, value)``: one signal on the event's own minute axis, truncated toward zero."""
    marks = events.withColumnRenamed(ts, "event_ts")
    slim = df.select(*[col(k) for k in keys], col(ts), col(signal).cast("double").alias("value"))
    if drop_missing:
        slim = slim.where(F.col("value").isNotNull())
    hits = around_events(slim, ts, marks, "event_ts", before, after, keys=keys, relative="__rel")
    return hits.select(
        *[col(k) for k in keys], "chemical", "event_type", "event_ts", F.col("__rel").cast("int").alias("rel_min"), "value"
    )


def rel_between(aligned: DataFrame, window: tuple[int, int], rel: str = "rel_min") -> DataFrame:
    return aligned.where(F.col(rel).between(*window))


def per_event_metrics(
    df: DataFrame,
    ts: str,
    events: DataFrame,
    signals: dict[str, str] | None = None,
    *,
    baseline: tuple[int, int] = plant.BASELINE_WINDOW,
    post: tuple[int, int] = plant.POST_WINDOW,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Response of each signal to each event: one row per event and signal.

    ``df`` has at most one row per key and minute, so an event's group is limited
    by its window. One range join and one exchange: the baseline median is
    spread over the group by a window on the same key as the final aggregate.
    """
    signals = {k: v for k, v in (signals or plant.SIGNALS).items() if v in df.columns}
    lo, hi = min(baseline[0], post[0]), max(baseline[1], post[1])
    marks = events.withColumnRenamed(ts, "event_ts")
    slim = df.select(*[col(k) for k in keys], col(ts), *[col(c) for c in dict.fromkeys(signals.values())])
    # one minute more on both sides: truncation toward zero lets it round into the window
    hits = around_events(slim, ts, marks, "event_ts", -lo + 1, hi + 1, keys=keys, relative="__rel")
    ident = [*keys, "chemical", "event_type", "event_ts"]
    rel = F.col("rel_min")
    before, after = rel.between(*baseline), rel.between(*post)
    long = (
        to_long(hits.withColumn("rel_min", F.col("__rel").cast("int")), [*ident, "rel_min"], signals, "signal", "value")
        .where(F.col("value").isNotNull() & (before | after))
        .withColumn("__pre", F.when(before, F.col("value")))
        .withColumn("__post", F.when(after, F.col("value")))
    )
    group = [*[col(i) for i in ident], F.col("signal")]
    long = long.withColumn("__base", F.expr("percentile(__pre, 0.5D)").over(Window.partitionBy(*group)))
    low = F.when(F.col("__post") < F.col("__base"), rel)
    q = F.expr("percentile(__post, array(0.25D, 0.5D, 0.75D))")
    out = long.groupBy(*group).agg(
        F.count("__pre").alias("__n_pre"),
        F.count("__post").alias("__n_post"),
        F.max("__base").alias("baseline"),
        q.alias("__q"),
        F.min_by(F.when(after, rel), F.when(after, F.struct("__post", rel))).alias("time_to_min"),
        F.coalesce(F.max(low) - F.min(low), F.lit(0)).alias("persistence"),
    )
    out = out.where((F.col("__n_pre") > 0) & (F.col("__n_post") > 0))
    out = out.withColumn("post", F.col("__q")[1]).withColumn("delta", F.col("post") - F.col("baseline"))
    out = out.withColumn(
        "percent_change", F.try_divide(F.col("delta"), F.nullif(F.col("baseline"), F.lit(0.0))) * 100
    ).withColumn("post_iqr", F.col("__q")[2] - F.col("__q")[0])
    return out.select(*group, *METRICS)


def event_metrics(per_event: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Median of every metric over the events of a kind, and the number of events.

    One exchange deals the metrics of a kind and one spilling sort per metric ranks them, so a kind with many events
    needs no more memory than another.
    """
    kind = [*keys, "chemical", "event_type", "signal"]
    long = to_long(per_event, kind, {m: m for m in METRICS}, "__metric", "__value")
    part = Window.partitionBy(*[col(k) for k in kind], F.col("__metric"))
    ranked = long.select(
        *[col(k) for k in kind],
        "__metric",
        "__value",
        F.row_number().over(part.orderBy(F.col("__value").asc_nulls_last())).alias("__row"),
        F.count("__value").over(part).alias("__n"),
        F.count(F.lit(1)).over(part).alias("__events"),
    )
    middle = (F.col("__row") == F.floor((F.col("__n") + 1) / 2)) | (F.col("__row") == F.floor(F.col("__n") / 2) + 1)
    medians = ranked.where(middle | (F.col("__row") == 1)).groupBy(*[col(k) for k in kind], "__metric").agg(
        F.avg(F.when(middle & (F.col("__n") > 0), F.col("__value"))).alias("__median"), F.max("__events").alias("__events")
    )
    return medians.groupBy(*[col(k) for k in kind]).agg(
        *[F.max(F.when(F.col("__metric") == m, F.col("__median"))).alias(m) for m in METRICS], F.max("__events").alias("n_events")
    )


def flag_unexpected(metrics: DataFrame) -> DataFrame:
    """Add ``warning`` where a median delta goes against the expected direction."""
    chem, kind, sig, d = (F.col(c) for c in ("chemical", "event_type", "signal", "delta"))
    return metrics.withColumn(
        "warning",
        F.when((chem == "Ferric") & (kind == "OFF") & (d < 0), "decrease after OFF")
        .when((chem == "Ferric") & (kind == "ON") & (d > 0), "increase after ON")
        .when((chem == "HCl") & (kind == "ON") & (sig == "NH3") & (d > 0), "increase after ON"),
    )


def strongest_effects(metrics: DataFrame, n: int = 3) -> DataFrame:
    """The n largest relative changes; ties in name order."""
    return (
        metrics.withColumn("abs_change", F.abs(F.col("percent_change")))
        .orderBy(F.col("abs_change").desc_nulls_last(), "chemical", "event_type", "signal")
        .limit(n)
    )


def study_summary(aligned: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Median and quartiles across events for every relative minute.

    Minutes where all events lack a value stay, with null statistics. A minute
    holds one value per event, so no group exceeds its share of the axis.
    """
    axis = [*keys, "chemical", "event_type", "rel_min"]
    return sorted_quantiles(
        aligned, "value", [0.5, 0.25, 0.75], by=axis, names=["median", "q25", "q75"], count="n_values"
    )


def pretrend_check(
    summary: DataFrame,
    *,
    window: tuple[int, int] = plant.PRETREND_WINDOW,
    tolerance: float = plant.PRETREND_TOLERANCE,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Stable iff the median moves at most ``tolerance`` before the event.

    No minute in the window counts as stable; minutes without any value do not.
    """
    inside = F.col("rel_min").between(*window)
    m = F.when(inside, F.col("median"))
    spread = F.max(m) - F.min(m)
    n: Column = F.count(F.when(inside, F.lit(1)))
    return summary.groupBy(*[col(k) for k in keys], "chemical", "event_type").agg(
        spread.alias("pre_variation"),
        F.when(n == 0, F.lit(True)).otherwise(F.coalesce(spread <= tolerance, F.lit(False))).alias("stable"),
    )


def metrics_table(
    df: DataFrame,
    ts: str,
    *,
    states: dict[str, str] | None = None,
    signals: dict[str, str] | None = None,
    baseline: tuple[int, int] = plant.BASELINE_WINDOW,
    post: tuple[int, int] = plant.POST_WINDOW,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Transitions, per-event response and medians in one lazy job."""
    have = present(df, (states or plant.STATES).values())
    if not have:
        raise ValueError("none of the state columns is present")
    found = transitions(df, ts, states, keys=keys)
    single = per_event_metrics(df, ts, found, signals, baseline=baseline, post=post, keys=keys)
    return event_metrics(single, keys=keys)
