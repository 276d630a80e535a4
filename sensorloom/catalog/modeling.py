"""Feature choice, model rows, persistence, evaluation, boosted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.catalog.base import Catalog, filled_grid, site_minutes, sql, table
from sensorloom.catalog.projections import MODELING_SQL
from sensorloom.functions.numeric import limit_metrics
from sensorloom.operators import features, model
from sensorloom.operators.grid import fill_gaps
from sensorloom.plans.build import modeling_table
from sensorloom.sources.sinks import settle

CATALOG = Catalog()
add = CATALOG.add


@add(
    "feature_choice",
    sql(
        f"""SELECT feature, n_values FROM (UNPIVOT (SELECT count(COLUMNS(lambda c: c NOT IN ('ts', 'p', 'n', 'ferric_d', 'hcl_d', 'split')
              AND NOT regexp_matches(c, '{"|".join(plant.LEAK_PATTERNS)}'))) FROM ({MODELING_SQL}))
            ON COLUMNS(*) INTO NAME feature VALUE n_values)""",
        "loaded",
    ),
)
def feature_choice(spark, d):
    """One row per chosen feature with its number of values in the modeling table."""
    whole = modeling_table(site_minutes(spark, d), "ts")
    chosen = model.feature_columns(whole)
    counts = whole.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(chosen)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n_values")) for i, c in enumerate(chosen)])
    return counts.select(F.explode(cells).alias("c")).select("c.*")


_LED = """led AS (SELECT k, ts, v, y FROM (
  SELECT k, ts, v, lead(v, 60) OVER (PARTITION BY k ORDER BY ts) AS y, v IS NULL OR v < 400 AS ok FROM filled)
  WHERE y IS NOT NULL AND ok)"""
_ROWS = f"""{_LED},
rows_ AS (SELECT k, ts, v, y, CASE WHEN p < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
    WHEN p < CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS model_split
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY k) AS n FROM led)),
guessed AS (SELECT *, coalesce(v, (SELECT median(y) FROM rows_ WHERE model_split = 'train')) AS guess FROM rows_)"""


def _with_rows(text: str) -> str:
    head, body = text.split("\nSELECT", 1)
    return f"{head},\n{_ROWS}\nSELECT{body}"


def _rows(spark, d):
    led = features.future_targets(
        filled_grid(spark, d), "ts", gases={"v": "v"}, raw=[], horizons=[60], limits={"v": 60.0}, keys=["k"]
    )
    usable = led.withColumn("ok", (F.col("v").isNull() | (F.col("v") < 400)).cast("int"))
    # the split reads its rows twice and the training median the split ones, so each is written once, with its five columns
    usable = usable.where("ok = 1 AND v_t_plus_60min IS NOT NULL").select("k", "ts", "v", F.col("v_t_plus_60min").alias("y"), "ok")
    rows = model.model_rows(settle(usable), "ts", "y", "ok", keys=["k"])
    return settle(rows.drop("ok"))


@add("model_rows", _with_rows(sql("SELECT k, ts, y, model_split FROM rows_", "filled", "y")))
def model_rows(spark, d):
    return _rows(spark, d).select("k", "ts", "y", "model_split")


@add("persistence_forecast", _with_rows(sql("SELECT k, ts, y, guess FROM guessed", "filled", "y guess")))
def persistence_forecast(spark, d):
    return model.with_persistence(_rows(spark, d), "y", "v", name="guess", stored=True).select("k", "ts", "y", "guess")


@add(
    "forecast_evaluation",
    _with_rows(
        sql(
            """SELECT k, model_split AS split, 'persistence' AS forecaster, count(*) AS n_rows, avg(abs(y - guess)) AS mae,
                 sqrt(avg((y - guess) ** 2)) AS rmse, 1 - avg((y - guess) ** 2) / nullif(var_pop(y), 0) AS r2,
                 avg(CAST((y >= 60) = (guess >= 60) AS INT)) AS accuracy,
                 count(*) FILTER (y >= 60 AND guess >= 60) / nullif(count(*) FILTER (guess >= 60), 0) AS precision,
                 count(*) FILTER (y >= 60 AND guess >= 60) / nullif(count(*) FILTER (y >= 60), 0) AS recall
               FROM guessed GROUP BY 1, 2""",
            "filled",
            "mae rmse r2 accuracy precision recall",
        )
    ),
)
def forecast_evaluation(spark, d):
    rows = model.with_persistence(_rows(spark, d), "y", "v", name="guess", stored=True).withColumnRenamed("model_split", "split")
    return model.evaluate(rows, truth="y", guesses={"persistence": "guess"}, limit=60.0, by=["k", "split"])


@add(
    "limit_metrics_on_labels",
    sql(
        """SELECT avg(CAST((quality >= 1) = (toxic >= 1) AS INT)) AS accuracy,
             count(*) FILTER (quality >= 1 AND toxic >= 1) / nullif(count(*) FILTER (toxic >= 1), 0) AS precision,
             count(*) FILTER (quality >= 1 AND toxic >= 1) / nullif(count(*) FILTER (quality >= 1), 0) AS recall FROM labels""",
        rounded="accuracy precision recall",
    ),
)
def limit_metrics_on_labels(spark, d):
    parts = limit_metrics("quality", "toxic", 1.0)
    return table(spark, d, "labels").agg(*[c.alias(n) for n, c in parts.items()])


_FILLED_SITE = """nb AS (SELECT ts, sensor_valid, x, h, {marks} FROM (
    SELECT ts, sensor_valid, nh3_roll_mean_15min AS x, h2s_roll_max_15min AS h FROM site)
  WINDOW up AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
gas AS (SELECT ts, sensor_valid, {cells} FROM nb),
led AS (SELECT *, lead(x, 60) OVER (ORDER BY ts) AS y, lead(h, 60) OVER (ORDER BY ts) AS yh FROM gas),
rows_ AS (SELECT ts, x, y, CASE WHEN p < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
    WHEN p < CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM led
    WHERE y IS NOT NULL AND yh IS NOT NULL AND sensor_valid = 1))""".format(
    marks=", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER up AS {c}_pt, last_value({c} IGNORE NULLS) OVER up AS {c}_pv, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER down AS {c}_nt, first_value({c} IGNORE NULLS) OVER down AS {c}_nv"
        for c in "xh"
    ),
    cells=", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN date_diff('minute', {c}_pt, ts) <= 10 THEN coalesce({c}_pv + ({c}_nv - {c}_pv) "
        f"* date_diff('minute', {c}_pt, ts) / nullif(date_diff('minute', {c}_pt, {c}_nt), 0), {c}_pv) END AS {c}"
        for c in "xh"
    ),
)


def _site_rows(text: str) -> str:
    head, body = text.split("\nSELECT", 1)
    return f"{head},\n{_FILLED_SITE}\nSELECT{body}"


def _site_table(spark, d):
    """Modeling table of one site; short gaps of the gases are filled first, as in the minute build."""
    gases = list(features.GASES.values())
    return modeling_table(fill_gaps(site_minutes(spark, d), "ts", gases, limit=plant.GAP_LIMIT_MIN), "ts")


_NH3 = {"target": f"{plant.NH3}_t_plus_60min", "current": plant.NH3, "valid": "model_row_valid_60min"}


@add(
    "forecast_rows",
    _site_rows(
        sql(
            """SELECT ts AS timestamp, split, 'nh3_t_plus_60min' AS target_name, y AS y_true,
                 coalesce(x, (SELECT median(y) FROM rows_ WHERE split = 'train')) AS y_pred_persistence FROM rows_""",
            "site",
            "y_true y_pred_persistence",
        )
    ),
)
def forecast_rows(spark, d):
    """The prediction table without the model's column."""
    rows = model.target_rows(_site_table(spark, d), "ts", **_NH3).withColumn("y_pred_model", F.lit(None).cast("double"))
    return model.prediction_table(rows, "ts", _NH3["target"], "nh3_t_plus_60min").drop("y_pred_model")


def _boosted(spark, d):
    """The forecast table of one site, at the default boosting settings on the rows that M2 calls valid."""
    return model.train_target(_site_table(spark, d), "ts", name="nh3_t_plus_60min", **_NH3)


@add("boosted_forecast")
def boosted_forecast(spark, d):
    return _boosted(spark, d)[1]


@add("boosted_forecast_metrics")
def boosted_forecast_metrics(spark, d):
    return model.evaluate(settle(_boosted(spark, d)[1]), limit=plant.LIMITS["nh3"])
