"""The two build jobs: minute master table and modeling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions import names as nm
from sensorloom.functions.names import col
from sensorloom.functions.numeric import number
from sensorloom.functions.timekit import minutes_between
from sensorloom.operators import dosing, features
from sensorloom.operators.clean import coerce, first_filled
from sensorloom.operators.grid import filled_minutes
from sensorloom.operators.windows import carry, chronological_split, with_halo
from sensorloom.operators.joins import outer_merge


def clean_names(df: DataFrame) -> DataFrame:
    df = nm.first_of_each_name(df)
    df = nm.drop_export_junk(df)
    return nm.fix_spelling(df, plant.MISSPELT)


def preprocess(
    merged: DataFrame,
    ts: str,
    *,
    keys: Sequence[str] = (),
    limit: int = plant.GAP_LIMIT_MIN,
    hold_words: Sequence[str] = (),
) -> DataFrame:
    """Numeric columns on the complete minute grid, gaps filled, missing rows marked.

    Columns whose name holds one of ``hold_words`` are carried past the gap limit.
    """
    df = clean_names(merged)
    values = [n for n in df.columns if n not in (*keys, ts)]
    binary = nm.binary_names(values, plant.BINARY_SUFFIX, plant.BINARY_NAMES)
    continuous = [n for n in values if n not in binary]
    df = coerce(df, continuous, binary)
    held = [c for c in continuous if any(w in c for w in hold_words)]
    df = filled_minutes(
        df, ts, means=continuous, maxima=binary, keys=keys, fill=continuous, limit=limit, hold=held, flag="interp_flag"
    )
    return df.withColumns({b: F.coalesce(col(b), F.lit(0)).cast("int") for b in binary}) if binary else df


def minute_table(tables: Sequence[DataFrame], ts: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Sensor and plant tables to the master minute table: one lazy plan."""
    df = preprocess(outer_merge(tables, ts, keys=keys), ts, keys=keys, hold_words=plant.CARRIED_WORDS)
    df = first_filled(df, plant.COMBINED, [plant.EAST])
    raw = {p: c for p, c in (("h2s", plant.RAW_H2S), ("nh3", plant.RAW_NH3)) if c in df.columns}
    df = features.drop_warmup(features.lag_and_roll(df, ts, raw, keys=keys), ts, keys=keys)
    df = dosing.operating_flags(df, ts)
    df = dosing.fixed_chemistry(df)
    return dosing.hcl_dose(dosing.ferric_dose(df, ts))


def modeling_table(
    minute: DataFrame,
    ts: str,
    *,
    keys: Sequence[str] = (),
    states: dict[str, str] | None = None,
    gases: dict[str, str] | None = None,
    raw: Sequence[str] = (plant.RAW_NH3, plant.RAW_H2S),
    horizons: Sequence[int] = tuple(plant.HORIZONS_MIN),
    limits: dict[str, float] | None = None,
) -> DataFrame:
    """Forecasting table from a complete minute grid.

    The steps are fused: one halo pass gives the previous states and the future
    targets, one carry fills the flows and finds the last events, and the split
    counts its buckets on the input.
    """
    states = {s: c for s, c in (states or plant.STATES).items() if c in minute.columns}
    gases = gases or features.GASES
    flows = nm.present(minute, plant.FLOWS)
    led = [*gases.values(), *raw]

    def edges(w):
        previous = {f"__prev_{s}": F.lag(features.state_now(c), 1).over(w) for s, c in states.items()}
        return {**previous, **features.leads(minute, led, horizons, w)}

    df = with_halo(minute, ts, edges, keys=keys, before=1, after=max(horizons))
    marks = features.change_marks(states, {s: F.col(f"__prev_{s}") for s in states}, ts)
    df = carry(df, ts, last={**{c: number(c) for c in flows}, **marks}, keys=keys)
    df = df.withColumns({m: minutes_between(m, ts) for m in marks}) if marks else df
    df = df.withColumns({c: F.coalesce(col(c), F.lit(0.0)) if c in flows else F.lit(0.0) for c in plant.FLOWS})
    df = df.drop(*[f"__prev_{s}" for s in states])
    df = dosing.load_columns(df, plant.FLOWS).withColumn("transferred_lbs_vol", F.col("lbs_per_min"))
    df = features.calendar(df, ts)
    df = features.interactions(df, states={s.lower(): c for s, c in states.items()}, gases=gases)
    df = features.target_columns(df, gases, horizons, limits or plant.LIMITS)
    df = features.quality_flags(df, gases=list(gases.values()), horizons=horizons)
    return chronological_split(
        df, ts, keys=keys, train=plant.TRAIN_SHARE, validation=plant.VALIDATION_SHARE, same_rows=minute
    )


def modeling_metadata(table: DataFrame, ts: str, horizons: Sequence[int] = tuple(plant.HORIZONS_MIN)) -> DataFrame:
    """One nested row: size, range, split counts, valid rows per horizon, horizons and limits."""
    n_columns = len(table.columns)

    def of(split: str):
        return F.count(F.when(F.col("split") == split, F.lit(1))).alias(split)

    return table.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_columns).alias("n_columns"),
        F.min(col(ts)).cast("string").alias("start"),
        F.max(col(ts)).cast("string").alias("end"),
        F.struct(of("test"), of("train"), of("validation")).alias("split_counts"),
        F.struct(*[F.sum(f"model_row_valid_{h}min").alias(f"h{h}") for h in horizons]).alias("valid_rows_by_horizon"),
        F.array(*[F.lit(h) for h in horizons]).alias("target_horizons_min"),
        F.struct(*[F.lit(v).alias(g) for g, v in plant.LIMITS.items()]).alias("threshold_targets"),
    )
