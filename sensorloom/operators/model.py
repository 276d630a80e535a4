"""Leak-free forecasting: feature choice, boosted trees, persistence baseline, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import col, numeric_names
from sensorloom.functions.numeric import error_metrics, limit_metrics
from sensorloom.operators.boosting import Boosted, Settings, fit, predict
from sensorloom.operators.quantiles import exact_quantiles
from sensorloom.operators.windows import chronological_split
from sensorloom.sources.sinks import settle

def feature_columns(
    df: DataFrame, *, patterns: Sequence[str] = tuple(plant.LEAK_PATTERNS), exclude: Sequence[str] = tuple(plant.LEAK_NAMES)
) -> list[str]:
    """Numeric columns whose name gives away nothing of the future, sorted."""
    return sorted(n for n in numeric_names(df) if n not in exclude and not any(p in n for p in patterns))


def model_rows(
    df: DataFrame, ts: str, target: str, valid: str, *, keys: Sequence[str] = (), column: str = "model_split"
) -> DataFrame:
    """Valid rows with a target, split again by position within themselves."""
    rows = df.where((col(valid) == 1) & col(target).isNotNull())
    return chronological_split(
        rows, ts, keys=keys, train=plant.TRAIN_SHARE, validation=plant.VALIDATION_SHARE, column=column
    )


def with_persistence(
    rows: DataFrame,
    target: str,
    current: str,
    *,
    split: str = "model_split",
    name: str = "y_pred_persistence",
    stored: bool = False,
) -> DataFrame:
    """Current value as the forecast; where it is missing, the training median of the target."""
    middle = exact_quantiles(rows.where(col(split) == "train"), target, [0.5], names=["__mid"], stored=stored)
    # one row, so the join is a constant
    return (
        rows.join(F.broadcast(middle), F.lit(True), "left")
        .withColumn(name, F.coalesce(col(current).cast("double"), F.col("__mid")))
        .drop("__mid")
    )


def target_rows(
    df: DataFrame, ts: str, *, target: str, current: str, valid: str, features: Sequence[str] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """The model rows of one target with their split and the persistence forecast.

    They are written once to the checkpoint folder: boosting reads them many times, and a lost executor then costs no
    more than one re-read.
    """
    wanted = dict.fromkeys([*keys, ts, target, current, valid, *features])
    rows = model_rows(df.select(*[col(c) for c in wanted]), ts, target, valid, keys=keys)
    return with_persistence(settle(rows), target, current, stored=True)


def train_target(
    df: DataFrame,
    ts: str,
    *,
    target: str,
    current: str,
    valid: str,
    name: str,
    features: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    **params,
) -> tuple[Boosted | None, DataFrame]:
    """Fit one target and return the model with its prediction table; ``params`` override the default boosting settings.

    Without a training row there is no model: it is None and its forecasts are NULL.
    """
    features = list(features or feature_columns(df))
    rows = settle(target_rows(df, ts, target=target, current=current, valid=valid, features=features, keys=keys))
    train = rows.where(F.col("model_split") == "train")
    if train.isEmpty():
        return None, prediction_table(rows.withColumn("y_pred_model", F.lit(None).cast("double")), ts, target, name, keys=keys)
    model = fit(train, target, features, Settings(**{**plant.BOOSTING, **params}))
    return model, prediction_table(predict(model, rows), ts, target, name, keys=keys)


def prediction_table(df: DataFrame, ts: str, target: str, name: str, *, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *[col(k) for k in keys],
        col(ts).alias("timestamp"),
        F.col("model_split").alias("split"),
        F.lit(name).alias("target_name"),
        col(target).alias("y_true"),
        F.col("y_pred_model"),
        F.col("y_pred_persistence"),
    )


def evaluate(
    predictions: DataFrame,
    *,
    truth: str = "y_true",
    guesses: dict[str, str] | None = None,
    limit: float | None = None,
    by: Sequence[str] = ("split",),
) -> DataFrame:
    """Error and limit metrics for each split and each forecaster, in one aggregate."""
    guesses = guesses or {"model": "y_pred_model", "persistence": "y_pred_persistence"}
    parts = {}
    for label, g in guesses.items():
        parts[label] = {**error_metrics(truth, g), **(limit_metrics(truth, g, limit) if limit is not None else {})}
    metrics = list(next(iter(parts.values())))
    wide = predictions.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[e.alias(f"{label}__{m}") for label, ms in parts.items() for m, e in ms.items()],
    )
    cells = F.array(
        *[
            F.struct(F.lit(label).alias("forecaster"), *[F.col(f"{label}__{m}").alias(m) for m in metrics])
            for label in parts
        ]
    )
    return wide.select(*[col(b) for b in by], "n_rows", F.explode(cells).alias("c")).select(
        *[col(b) for b in by], "n_rows", "c.*"
    )
