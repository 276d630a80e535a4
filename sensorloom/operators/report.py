"""Small result tables for a report: every one is an aggregate or a top-k of its input."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom import plant
from sensorloom.functions.names import col, present
from sensorloom.functions.numeric import dose_mgl_from_gpm, ratio
from sensorloom.functions.timekit import as_time
from sensorloom.operators.features import first_to_last_change
from sensorloom.operators.joins import to_long
from sensorloom.operators.quantiles import exact_quantiles
from sensorloom.sources.sinks import settle


def coverage_pct(value: str | Column, expected: Column | int) -> Column:
    """Aggregate: share of expected points that hold a value, NULL without any value."""
    want = expected if isinstance(expected, Column) else F.lit(expected)
    n = F.count(col(value))
    return F.when((n > 0) & (want > 0), ratio(n * 100.0, want))


def metric(value: str | Column, how: str = "mean") -> Column:
    """Aggregate of the non-null values by name; NULL without any."""
    named = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_samp, "count": F.count}
    if how not in named:
        raise ValueError(f"unknown aggregate {how!r}")
    return named[how](col(value))


def window_summary(
    df: DataFrame,
    ts: str,
    events: DataFrame,
    *,
    gases: dict[str, str] | None = None,
    flow: str = "total_gpm",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Range, transition count, coverage, mean flow and gas change of the reporting window."""
    gases = {g: c for g, c in (gases or {"nh3": plant.NH3, "h2s": plant.H2S}).items() if c in df.columns}
    aggs = {
        "first_day": F.to_date(F.min(as_time(ts))),
        "last_day": F.to_date(F.max(as_time(ts))),
        "n_rows": F.count(F.lit(1)),
        "mean_flow": F.avg(col(flow)) if flow in df.columns else F.lit(None).cast("double"),
    }
    for g, c in gases.items():
        aggs[f"{g}_coverage_pct"] = coverage_pct(c, F.count(F.lit(1)))
        aggs[f"{g}_delta"] = first_to_last_change(c, ts)
    out = df.groupBy(*[col(k) for k in keys]).agg(*[a.alias(n) for n, a in aggs.items()])
    for g in gases:
        d = F.col(f"{g}_delta")
        out = out.withColumn(f"{g}_direction", F.when(d > 0, "up").when(d < 0, "down").when(d == 0, "flat"))
    n = events.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("transitions"))
    joined = out.join(n, list(keys), "left") if keys else out.crossJoin(F.broadcast(n))  # one row each
    return joined.withColumn("transitions", F.coalesce("transitions", F.lit(0)))


def chemistry_review(df: DataFrame) -> DataFrame:
    """Median feed and dose intensity with their availability, one row per review item."""
    none = F.lit(None).cast("double")
    items: dict[str, tuple[Column | None, str, str]] = {}
    for chem, label in (("ferric", "Ferric"), ("hcl", "HCl")):
        feed, active = f"{chem}_solution_lbs_per_day", f"{chem}_active_lbs_per_day"
        if feed in df.columns:
            items[f"{label} solution feed context"] = (col(feed), "lb/day", "Available as secondary context")
        mgl = dose_mgl_from_gpm(active, "total_gpm") if len(present(df, [active, "total_gpm"])) == 2 else none
        items[f"{label} dose intensity"] = (mgl, "mg/L", "Primary interpretation metric")
    cols = {f"__i{i}": v for i, (v, _, _) in enumerate(items.values())}
    # four slim columns, written once: the search reads them once a level
    slim = settle(df.select(*[v.cast("double").alias(n) for n, v in cols.items()]))
    long = to_long(slim, [], {n: n for n in cols}, "k", "v")
    counts = long.groupBy("k").agg(F.count("v").alias("n"))
    mids = exact_quantiles(long, "v", [0.5], by=["k"], names=["median"], stored=True)
    labels = F.create_map(
        *[x for i, (name, (_, unit, ok)) in enumerate(items.items())
          for x in (F.lit(f"__i{i}"), F.struct(F.lit(name).alias("item"), F.lit(unit).alias("unit"), F.lit(ok).alias("ok")))]
    )
    hcl_cols = present(df, ["hcl_solution_lbs_per_day", "hcl_active_lbs_per_day", "hcl_active_mg_per_L"])
    measured = counts.join(mids, "k", "left").select(
        labels[F.col("k")]["item"].alias("workflow_element"),
        F.when(F.col("n") > 0, labels[F.col("k")]["ok"]).otherwise("Missing in current window").alias("status"),
        F.col("median").alias("median"),
        labels[F.col("k")]["unit"].alias("unit"),
    )
    known = [
        ("Fixed chemistry context", "Available", plant.PH, "pH"),
        ("Ferric reduction date", "Available", None, plant.FERRIC_CUT.split()[0]),
        ("HCl dosing features", "Available" if hcl_cols else "Not yet implemented", None, ", ".join(hcl_cols)),
    ]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("workflow_element"),
                    F.lit(s).alias("status"),
                    F.lit(v).cast("double").alias("median"),
                    F.lit(u).alias("unit"),
                )
                for n, s, v, u in known
            ]
        )
    )
    fixed = df.sparkSession.range(1).select(rows.alias("r")).select("r.*")
    return fixed.unionByName(measured)


def top_rows(
    df: DataFrame, columns: Sequence[str], *, sort: str | None = None, n: int = 200, ties: Sequence[str] | None = None
) -> DataFrame:
    """Chosen columns, largest first, at most ``n`` rows: a top-k, not a full sort.

    ``ties`` (default: the chosen columns) settle which of equal rows stay.
    """
    order = [col(sort).desc_nulls_last()] if sort else []
    order += [col(c).asc_nulls_last() for c in (columns if ties is None else ties)]
    return df.orderBy(*order).select(*[col(c) for c in columns]).limit(n)


def latest_rows(df: DataFrame, ts: str, n: int = 5000, *, ties: Sequence[str] | None = None) -> DataFrame:
    """The last ``n`` rows by time; ``ties`` (default: the other columns) settle equal times."""
    rest = [c for c in df.columns if c != ts] if ties is None else ties
    return df.orderBy(col(ts).desc(), *[col(c).asc_nulls_last() for c in rest]).limit(n)


def dataset_status(tables: dict[str, DataFrame | None], coverage: dict[str, str] | None = None) -> DataFrame:
    """One row per dataset: presence, rows, and coverage of the named columns where they exist."""
    coverage = coverage or {"nh3": plant.NH3, "h2s": plant.H2S}
    given = {n: t for n, t in tables.items() if t is not None}
    if not given:
        raise ValueError("no table is given")
    parts = []
    for name, t in given.items():
        marks = [
            (coverage_pct(c, F.count(F.lit(1))) if c in t.columns else F.lit(None).cast("double")).alias(f"{g}_coverage_pct")
            for g, c in coverage.items()
        ]
        parts.append(t.agg(F.count(F.lit(1)).alias("n_rows"), *marks).select(F.lit(name).alias("dataset"), "*"))
    out = reduce(lambda a, b: a.unionByName(b), parts).withColumn("present", F.lit(True))
    absent = [n for n in tables if tables[n] is None]
    if absent:
        spark = out.sparkSession
        rest = spark.createDataFrame([(n, 0, False) for n in absent], "dataset string, n_rows bigint, present boolean")
        out = out.unionByName(rest, allowMissingColumns=True)
    return out


def table_range(df: DataFrame, ts: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Row count and time range, for metadata."""
    return df.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(col(ts)).alias("start"), F.max(col(ts)).alias("end")
    )
