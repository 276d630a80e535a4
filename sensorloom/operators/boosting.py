"""Histogram gradient boosting for squared error, with a bin and a learned direction for missing values.

Each feature is cut into at most ``bins`` classes at observed quantiles; NULL and NaN have a class of their own. A tree grows
level by level: tasks add up residuals and rows per (node, feature, class) over their own blocks, the sums meet in a tree
reduction, and the driver picks the splits. What moves is bounded by nodes x features x classes, whatever the number of
rows. Of the splits found, those with the greatest gain are kept until the tree has ``leaves`` leaves.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sensorloom.functions.names import col

#: Rows that a task works on at a time.
BLOCK = 1 << 16
#: Rounds after which the residuals are written to the checkpoint folder.
KEPT_ROUNDS = 25
#: Rows of a partition while there are idle cores.
PART_ROWS = 1 << 15
#: Up to so many partial sums the driver adds itself.
FEW_PARTS = 8


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    rate: float = 0.05
    depth: int = 6
    leaves: int = 31
    min_leaf: int = 50
    l2: float = 0.1
    bins: int = 255


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1. Classes up to ``cut`` go left, missing values where ``missing_left`` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node] = feature, cut, missing_left
        self.left[node], self.right[node] = n, n + 1
        for v in values:
            for part, x in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, v)):
                part.append(x)
        return n, n + 1

    def place(self, classes: np.ndarray, missing: int) -> np.ndarray:
        """The leaf of each row of classes."""
        feature, cut, side = np.array(self.feature), np.array(self.cut), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(classes), dtype=np.int64)
        todo = np.arange(len(classes)) if feature[0] >= 0 else np.zeros(0, dtype=np.int64)
        while len(todo):
            node = at[todo]
            x = classes[todo, feature[node]]
            goes_left = np.where(x == missing, side[node], x <= cut[node])
            at[todo] = np.where(goes_left, left[node], right[node])
            todo = todo[feature[at[todo]] >= 0]
        return at


@dataclass
class Boosted:
    """A fitted model: ``start`` plus the leaves' values over all trees."""

    features: list[str]
    cuts: list[list[float]]
    start: float
    trees: list[Tree]
    settings: Settings

    @property
    def missing(self) -> int:
        return 1 + max(map(len, self.cuts), default=0)

    def classes(self, values: np.ndarray) -> np.ndarray:
        """Class of each value: the number of cuts below it; ``missing`` for NaN."""
        out = np.empty(values.shape, dtype=np.uint8)
        for i, cuts in enumerate(self.cuts):
            x = values[:, i]
            out[:, i] = np.where(np.isnan(x), self.missing, np.searchsorted(cuts, x, side="left"))
        return out

    def predict(self, values: np.ndarray) -> np.ndarray:
        classes, out = self.classes(values), np.full(len(values), self.start)
        for tree in self.trees:
            out += np.array(tree.value)[tree.place(classes, self.missing)]
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Boosted:
        given = json.loads(text)
        return Boosted(**{**given, "trees": [Tree(**t) for t in given["trees"]], "settings": Settings(**given["settings"])})


def _values(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The first ``n`` columns as a matrix; NULL is NaN."""
    cols = [batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(n)]
    return np.column_stack(cols) if cols else np.empty((batch.num_rows, 0))


def _cuts(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Observed quantiles of each feature below its maximum, all features in one aggregate."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    number = [F.nanvl(col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    row = rows.agg(
        *[F.percentile_approx(c, shares, F.lit(40 * bins)).alias(f"q{i}") for i, c in enumerate(number)],
        *[F.max(c).alias(f"m{i}") for i, c in enumerate(number)],
    ).first()
    return [sorted({x for x in row[f"q{i}"] or [] if x < row[f"m{i}"]}) for i in range(len(features))]


def _blocks(rows: DataFrame, target: str, model: Boosted) -> RDD:
    """``(classes, residuals)`` of about ``BLOCK`` rows each."""
    n = len(model.features)
    given = rows.select(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(model.features)], col(target).cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(n).to_numpy(zero_copy_only=False) - model.start
            yield pa.RecordBatch.from_arrays([pa.array([model.classes(_values(batch, n)).tobytes()]), pa.array([y.tobytes()])], names=["x", "y"])

    def joined(parts) -> Iterator[tuple]:
        held, size = [], 0
        for p in parts:
            y = np.frombuffer(p.y, dtype=np.float64)
            held.append((np.frombuffer(p.x, dtype=np.uint8).reshape(len(y), n), y))
            size += len(y)
            if size >= BLOCK:
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held, size = [], 0
        if held:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

    return given.mapInArrow(run, "x binary, y binary").rdd.mapPartitions(joined)


def _sums(blocks: RDD, tree: Tree, nodes: list[int], n_features: int, n_classes: int) -> np.ndarray:
    """``[node, (residuals, rows), feature, class]`` of the named leaves. Tasks send the cells that they have rows in."""
    number = np.full(len(tree.feature), -1, dtype=np.int64)
    number[nodes] = np.arange(len(nodes))
    missing, cells = n_classes - 1, len(nodes) * n_classes

    def run(parts) -> Iterator[tuple]:
        r_sum, n_sum = np.zeros((n_features, cells)), np.zeros((n_features, cells), dtype=np.int64)
        for classes, residual in parts:
            at = number[tree.place(classes, missing)]
            inside = np.flatnonzero(at >= 0)
            base, r = at[inside] * n_classes, residual[inside]
            for f in range(n_features):
                cell = base + classes[inside, f]
                r_sum[f] += np.bincount(cell, r, cells)
                n_sum[f] += np.bincount(cell, minlength=cells)
        used = np.flatnonzero(n_sum)
        yield used, r_sum.ravel()[used], n_sum.ravel()[used]

    def added(a: tuple, b: tuple) -> tuple:
        used, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        return used, np.bincount(at, np.concatenate([a[1], b[1]])), np.bincount(at, np.concatenate([a[2], b[2]])).astype(np.int64)

    parts = blocks.mapPartitions(run)
    used, r, n = parts.reduce(added) if blocks.getNumPartitions() <= FEW_PARTS else parts.treeReduce(added)
    out = np.zeros((len(nodes), 2, n_features, n_classes))
    feature, cell = np.divmod(used, cells)
    node, kind = np.divmod(cell, n_classes)
    out[node, 0, feature, kind], out[node, 1, feature, kind] = r, n
    return out


def best_split(sums: np.ndarray, s: Settings) -> tuple | None:
    """``(gain, feature, cut, missing_left, (rows, residuals) left, right)`` of one node from its ``[2, feature, class]`` sums.

    Among equal gains missing values go right, then the first feature, then the lowest cut. A direction is learned only
    where the node has missing values; elsewhere they would follow the greater child.
    """
    total, rows = sums[0, 0].sum(), sums[1, 0].sum()
    if rows < 2 * s.min_leaf:
        return None
    known, lost = sums[:, :, :-1].cumsum(axis=2)[:, :, :-1], sums[:, :, -1]
    whole = total**2 / (rows + s.l2)
    best = None
    for missing_left in (False, True):
        names = np.flatnonzero(lost[1] > 0) if missing_left else np.arange(sums.shape[1])
        r, n = (known[:, names] + lost[:, names, None]) if missing_left else known
        fits = (n >= s.min_leaf) & (n <= rows - s.min_leaf)
        f, c = np.nonzero(fits)
        if not len(f):
            continue
        r, n = r[f, c], n[f, c]
        gain = r * r / (n + s.l2) + (total - r) ** 2 / (rows - n + s.l2) - whole
        k = int(gain.argmax())
        if gain[k] > 1e-12 * max(1.0, whole) and (best is None or gain[k] > best[0]):
            feature, side = int(names[f[k]]), missing_left if lost[1, names[f[k]]] else n[k] > rows - n[k]
            best = (float(gain[k]), feature, int(c[k]), bool(side), (float(n[k]), float(r[k])), (float(rows - n[k]), float(total - r[k])))
    return best


def _grown(blocks: RDD, s: Settings, n_features: int, n_classes: int) -> Tree | None:
    """The tree of one round; None where no row can be parted.

    Of two children only the smaller one is added up; the other has what is left of their parent.
    """
    tree, found, sums = Tree(), {}, {}
    waiting: list[tuple[int, int | None, int | None]] = [(0, None, None)]  # (to add up, its parent, the other child)
    for _ in range(s.depth):
        following = []
        own = _sums(blocks, tree, [w[0] for w in waiting], n_features, n_classes)
        for (node, parent, other), cells in zip(waiting, own):
            sums[node] = cells
            if other is not None:
                sums[other] = sums[parent] - cells
        for parent in {w[1] for w in waiting} - {None}:
            del sums[parent]
        for node in sorted(x for w in waiting for x in (w[0], w[2]) if x is not None):
            split = best_split(sums[node], s)
            if split is None:
                del sums[node]
                continue
            values = tuple(s.rate * r / (n + s.l2) for n, r in split[4:])
            left, right = tree.split(node, *split[1:4], values)
            found[node] = (split[0], left, right)
            if max(split[4][0], split[5][0]) >= 2 * s.min_leaf:
                small, great = (left, right) if split[4][0] <= split[5][0] else (right, left)
                following.append((small, node, great))
        waiting = following
        if not waiting:
            break
    return _pruned(tree, found, s.leaves) if found else None


def _pruned(tree: Tree, found: dict[int, tuple], leaves: int) -> Tree:
    """The splits that come first when always the one with the greatest gain is made next."""
    out, number = Tree(value=[tree.value[0]]), {0: 0}
    waiting, n = [(-found[0][0], 0)] if 0 in found else [], 1
    while waiting and n < leaves:
        _, node = heapq.heappop(waiting)
        kids = found[node][1:]
        made = out.split(number[node], tree.feature[node], tree.cut[node], tree.missing_left[node], (tree.value[kids[0]], tree.value[kids[1]]))
        n += 1
        for old, new in zip(kids, made):
            number[old] = new
            if old in found:
                heapq.heappush(waiting, (-found[old][0], old))
    return out


def fit(rows: DataFrame, target: str, features: Sequence[str], settings: Settings | None = None) -> Boosted:
    """Fit on settled rows with a target. Binned blocks stay in memory, a byte a cell, or on disk; a lost one is made again.

    Rounds end early once no tree can part the rows: all later ones would be empty.
    """
    s = settings or Settings()
    if not 1 < s.bins <= 255:
        raise ValueError("classes are numbered in a byte")
    start, n_rows = rows.agg(F.avg(col(target).cast("double")), F.count("*")).first()
    model = Boosted(list(features), _cuts(rows, features, s.bins) if features else [], float(start), [], s)
    if not features:
        return model
    missing = model.missing
    parts = max(1, min(-(-n_rows // PART_ROWS), 3 * rows.sparkSession.sparkContext.defaultParallelism))
    state, before = _blocks(rows.coalesce(parts), target, model).persist(StorageLevel.MEMORY_AND_DISK), None
    for k in range(s.rounds):
        tree = _grown(state, s, len(model.features), missing + 1)
        if before is not None:
            before.unpersist()
        if tree is None:
            break
        model.trees.append(tree)
        values = np.array(tree.value)
        before, state = state, state.map(_after(tree, values, missing)).persist(StorageLevel.MEMORY_AND_DISK)
        if k % KEPT_ROUNDS == KEPT_ROUNDS - 1:  # cuts the lineage
            state.checkpoint()
            state.count()
    state.unpersist()
    return model


def _after(tree: Tree, values: np.ndarray, missing: int):
    def step(block: tuple) -> tuple:
        return block[0], block[1] - values[tree.place(block[0], missing)]

    return step


def predict(model: Boosted, df: DataFrame, name: str = "y_pred_model") -> DataFrame:
    """All columns and the forecast. The model, bounded by its settings, goes to every task."""
    if name in df.columns:
        raise ValueError(f"{name} is taken")
    n, held = len(model.features), df.sparkSession.sparkContext.broadcast(model)
    given = df.select(*[col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(model.features)], *[col(c) for c in df.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array(held.value.predict(_values(batch, n)))
            names = batch.schema.names[n:]
            yield pa.RecordBatch.from_arrays([*(batch.column(i + n) for i in range(len(names))), out], names=[*names, name])

    return given.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def stored(spark: SparkSession, model: Boosted) -> DataFrame:
    """The model as one row of text."""
    return spark.createDataFrame([(model.to_json(),)], "model string")


def loaded(df: DataFrame) -> Boosted:
    return Boosted.from_json(df.first().model)
