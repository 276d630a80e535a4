"""Training of all targets, and the folder that holds its outcome.

A run writes models, predictions, metrics and a summary into a folder of its own; the manifest, written last, names the
run that is complete. A reader follows the manifest, so it never meets half a run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.operators import boosting, features
from sensorloom.operators.boosting import Boosted
from sensorloom.operators.model import evaluate, feature_columns, train_target
from sensorloom.sources.sinks import settle, write_json, write_small
from sensorloom.sources.tables import path_exists

TARGETS = {
    f"{g}_t_plus_60min": {
        "target": f"{c}_t_plus_60min",
        "current": c,
        "valid": "model_row_valid_60min",
        "limit": plant.LIMITS[g],
    }
    for g, c in features.GASES.items()
}
#: Features that the summary names.
PREVIEW = 25


@dataclass
class Trained:
    """One target: the model (None without a training row), predictions, metrics by split and forecaster."""

    model: Boosted | None
    predictions: DataFrame
    metrics: DataFrame


def train_all(table: DataFrame, ts: str, *, targets: dict | None = None, **params) -> dict[str, Trained]:
    """Fit every target on the leak-free features of one modeling table."""
    chosen = feature_columns(table)
    out = {}
    for name, cfg in (targets or TARGETS).items():
        model, predictions = train_target(
            table, ts, target=cfg["target"], current=cfg["current"], valid=cfg["valid"], name=name, features=chosen, **params
        )
        predictions = settle(predictions)  # read by the metrics and by the writer
        out[name] = Trained(model, predictions, evaluate(predictions, limit=cfg.get("limit")))
    return out


def write_training(table: DataFrame, results: dict[str, Trained], path: str, *, source: str = "", run: str | None = None) -> str:
    """Write one run and then the manifest; gives the run's name."""
    spark, run = table.sparkSession, run or uuid.uuid4().hex
    place, chosen = f"{path}/runs/{run}", feature_columns(table)
    for name, one in results.items():
        if one.model is not None:
            write_small(boosting.stored(spark, one.model), f"{place}/models/{name}")
        write_small(one.predictions, f"{place}/predictions/{name}")
        write_json(one.metrics.coalesce(1), f"{place}/metrics/{name}")
    splits = None
    for name, one in results.items():
        counts = one.metrics.select(F.lit(name).alias("target_name"), "split", "n_rows").distinct()
        splits = counts if splits is None else splits.unionByName(counts)
    summary = table.agg(F.count("*").alias("n_total_rows")).select(
        F.lit(source).alias("source"),
        "n_total_rows",
        F.lit(len(chosen)).alias("n_feature_columns"),
        F.array(*[F.lit(c) for c in chosen[:PREVIEW]]).cast("array<string>").alias("feature_columns_preview"),
        F.array(*[F.lit(n) for n in results]).cast("array<string>").alias("targets"),
    )
    write_json(summary.coalesce(1), f"{place}/summary")
    if splits is not None:
        write_json(splits.coalesce(1), f"{place}/splits")
    with_model = [n for n, one in results.items() if one.model is not None]
    manifest = [(run, list(results), with_model)]
    write_json(spark.createDataFrame(manifest, "run string, targets array<string>, models array<string>").coalesce(1), f"{path}/manifest")
    return run


def read_training(spark: SparkSession, path: str) -> tuple[dict[str, Trained], DataFrame] | None:
    """``(results by target, summary)`` of the complete run of a folder; None where there is none."""
    if not path_exists(spark, f"{path}/manifest/_SUCCESS"):
        return None
    row = spark.read.schema("run string, targets array<string>, models array<string>").json(f"{path}/manifest").first()
    place = f"{path}/runs/{row.run}"
    out = {}
    for name in row.targets:
        model = boosting.loaded(spark.read.parquet(f"{place}/models/{name}")) if name in row.models else None
        out[name] = Trained(model, spark.read.parquet(f"{place}/predictions/{name}"), spark.read.json(f"{place}/metrics/{name}"))
    return out, spark.read.json(f"{place}/summary")
