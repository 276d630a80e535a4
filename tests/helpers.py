"""Small builders shared by the tests."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F


def minutes(n, start="2026-01-01", freq="1min"):
    return pd.date_range(start, periods=n, freq=freq)


def frame(spark, pdf):
    """pandas to Spark through Arrow, which turns NaN into NULL."""
    return spark.createDataFrame(pa.Table.from_pandas(pdf, preserve_index=False)).withColumns(
        {n: F.col(f"`{n}`").cast("timestamp") for n, t in pdf.dtypes.items() if t.kind == "M"}
    )


def noisy_series(n, seed, missing=0.2, start="2026-01-01 07:13"):
    rng = np.random.default_rng(seed)
    v = rng.normal(10, 3, n).round(2)
    v[rng.random(n) < missing] = np.nan
    return pd.DataFrame({"ts": minutes(n, start), "v": v})


def pandas_of(df, by):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def same(got, want, tol=1e-9):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    np.testing.assert_allclose(got, want, rtol=tol, atol=tol)
