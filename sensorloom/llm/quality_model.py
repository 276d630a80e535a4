"""Regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sensorloom.functions.names import col
from sensorloom.llm.common import fresh, raw, slices, with_columns, without

FEATURES = (
    "log words", "mean word length", "word length spread", "distinct words", "neighbour repeats", "capitals", "digits",
    "stops", "marks", "symbols", "doubled marks", "log words a line", "repeated lines", "octet entropy", "other octets",
)
_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?", b"!'\"()-", b"#*$%&|<>@=_{}[]\\/+~^"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7


def statistics(text: bytes) -> list[float]:
    """``FEATURES`` of one text, already transformed: logs of counts, square roots of shares."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    octets = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(octets, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=8)
    share = np.sqrt(kinds / size)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    lines = [x for x in text.split(b"\n") if x]
    p = counts[counts > 0] / size
    capitals = np.sqrt(kinds[1] / max(kinds[1] + kinds[2], 1))
    doubled = np.count_nonzero((octets[1:] == octets[:-1]) & (_CLASS[octets[1:]] >= 4) & (_CLASS[octets[1:]] <= 6))
    return [
        float(np.log1p(n)),
        float(np.log(lengths.mean())),
        float(np.log1p(lengths.std())),
        float(np.sqrt(len(set(words)) / n)),
        float(np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / n)),
        float(capitals),
        float(share[3]),
        float(share[4]),
        float(share[5]),
        float(share[6]),
        float(np.sqrt(doubled / n)),
        float(np.log1p(n / max(len(lines), 1))),
        float(np.sqrt(1 - len(set(lines)) / max(len(lines), 1))),
        float(-(p * np.log2(p)).sum()),
        float(share[7]),
    ]


def described(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) and ``features``, an array, of the whole text; a null or blank text has zeros.

    A kept column named ``features`` gives way to the new one.
    """
    carried = fresh(docs, "stat_text")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "features"]
    base = docs.select(*[col(c) for c in kept], col(text).cast("string").alias(carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, carried):
            rows = pa.array([statistics(t) for t in raw(part, carried)], type=pa.list_(pa.float64()))
            yield with_columns(part, {carried}, features=rows)

    schema = StructType([*base.schema.fields[:-1], StructField("features", ArrayType(DoubleType()))])
    return base.mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunk covariances, and their constant terms; class 1 second."""

    scale: np.ndarray
    centre: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    constant: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the two Mahalanobis log densities."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        dens = [c - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constant)]
        return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -700, 700)))


def _moments(rows: DataFrame, label: str, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products per class: each task adds up its rows, Spark adds up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("features").to_pylist(), dtype=np.float64)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            y = b.column("y").to_numpy(zero_copy_only=False)
            for k in np.unique(y).tolist():
                part = x[y == k]
                held[k] = held.get(k, 0) + part.T @ part
        for k, m in held.items():
            n = m.size
            yield pa.RecordBatch.from_arrays([pa.array([int(k)] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(m.ravel())], names=["y", "i", "v"])

    parts = rows.select(F.col(label).cast("long").alias("y"), "features").mapInArrow(run, "y long, i long, v double")
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # two classes, (d + 1) squared numbers each
        out.setdefault(r.y, np.zeros((d + 1) ** 2))[r.i] = r.v
    return {k: (m.reshape(d + 1, d + 1)[0, 0], m.reshape(d + 1, d + 1)[0, 1:], m.reshape(d + 1, d + 1)[1:, 1:]) for k, m in out.items()}


def fit(rows: DataFrame, label: str, *, pooled: float = 0.1, ridge: float = 0.05) -> Discriminant | None:
    """Fit on labelled rows of ``described``; labels other than 0 and 1 are left out.

    Each class covariance is shrunk by ``pooled`` toward the pooled one and by ``ridge`` toward a multiple of the unit
    matrix. With fewer than two rows of a class there is no model.
    """
    d = len(FEATURES)
    got = _moments(rows.where(F.col(label).isin(0, 1)), label, d)
    if any(k not in got or got[k][0] < 2 for k in (0, 1)):
        return None
    n = sum(m[0] for m in got.values())
    centre = sum(m[1] for m in got.values()) / n
    second = sum(m[2] for m in got.values()) / n - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(second), 1e-9))
    means, covs = [], []
    for k in (0, 1):
        c, s, o = got[k]
        mean = s / c
        means.append((mean - centre) / scale)
        covs.append((o / c - np.outer(mean, mean)) / np.outer(scale, scale))
    shared = sum(got[k][0] / n * covs[k] for k in (0, 1))
    whiten, constant = [], []
    for k in (0, 1):
        cov = (1 - pooled) * covs[k] + pooled * shared
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / d * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        constant.append(float(np.log(got[k][0] / n) - np.log(np.diag(factor)).sum()))
    return Discriminant(scale, centre, tuple(means), tuple(whiten), tuple(constant))


def scored(rows: DataFrame, model: Discriminant | None, *, least: float = 0.7) -> DataFrame:
    """Rows of ``described`` without the features, with ``score`` (0 to 1) and ``predicted`` (1 from ``least`` on).

    Blank texts are scored like others, by their zeros. Without a model every score is 0.5. Equal texts get equal
    scores; an empty table gives an empty result. Columns named ``score`` or ``predicted`` give way to the new ones.
    """
    rows = without(rows, "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("features").to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            score = model.score(x) if model and b.num_rows else np.full(b.num_rows, 0.5)
            yield with_columns(b, {"features"}, score=pa.array(score))

    schema = StructType([*[f for f in rows.schema.fields if f.name != "features"], StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
