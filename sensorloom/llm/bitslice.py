"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one index block, a multiple of 64, queries of one group, and groups that meet a block in one row.
BLOCK_ROWS, GROUP, GROUPS_A_ROW = 16_384, 64, 32
#: Low bits of an attribute that the index leaves out; the rows they could decide are resolved exactly.
DROPPED = 1
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def usable(vector: Column) -> Column:
    """Not null, without null, NaN or infinite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def quantised(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of each component; beyond the range of a long it is the nearest long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


# ------------------------------------------------------------------- bitmaps
def _pack(flags: np.ndarray) -> np.ndarray:
    """Bitmaps (64 rows a word) of ``[slice, row]`` flags."""
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """Bit slices of the attributes of up to ``BLOCK_ROWS`` rows, moved to start at zero, and the values themselves."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        n, dims = values.shape
        self.ids, self.values, self.n = ids, values, n
        self.low = values.min(axis=0) if n else np.zeros(dims, dtype=np.int64)
        moved = np.zeros((dims, -(-max(n, 1) // 64) * 64), dtype=np.uint64)
        moved[:, :n] = ((values - self.low).astype(np.uint64) >> np.uint64(DROPPED)).T
        self.slices = []  # per attribute: [bit, word], as many bits as it needs
        for row in moved:
            bits = int(row.max()).bit_length()
            flags = (row[None, :] >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)
            self.slices.append(_pack(flags.astype(bool)) if bits else np.zeros((0, moved.shape[1] // 64), np.uint64))
        self.rows = _pack((np.arange(moved.shape[1]) < n)[None, :])[0]

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum over attributes of ``query`` times the sliced value, up to a constant.

        A weight is added bit by bit: each of its set bits adds the attribute's slices one place up. A slice with a
        negative weight is added as its complement, which changes the sum by a constant. Slices of one place are
        added three at a time by full adders.
        """
        places: list[list[np.ndarray]] = [[] for _ in range(140)]
        for q, bits in zip(query.tolist(), self.slices):
            if not q or not len(bits):
                continue
            use, weight = (bits, q) if q > 0 else (~bits, -q)
            shift = 0
            while weight:
                if weight & 1:
                    for j in range(len(use)):
                        places[j + shift].append(use[j : j + 1])
                weight >>= 1
                shift += 1
        out = []
        for p in range(len(places) - 1):
            if not places[p]:
                out.append(np.zeros_like(self.rows))
                continue
            level = np.concatenate(places[p])
            while len(level) > 1:
                m = len(level) // 3
                if m:
                    x, y, z = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
                    half = x ^ y
                    places[p + 1].append((x & y) | (half & z))
                    level = np.concatenate([half ^ z, level[3 * m :]])
                else:
                    places[p + 1].append(level[:1] & level[1:2])
                    level = level[:1] ^ level[1:2]
            out.append(level[0])
        while out and not out[-1].any():
            out.pop()
        return out

    def best(self, query: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, list[int]]:
        """The ``k`` best rows, without the row whose id is ``skip``; ties go to the smaller id."""
        alive = self.rows.copy()
        own = np.flatnonzero(self.ids == skip)
        for r in own.tolist():
            alive[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        count = lambda b: int(np.bitwise_count(b).sum())
        if count(alive) > k:
            slices = self.sums(query)
            # from the top slice down: rows above the boundary, and rows equal to it so far
            above, equal, boundary = np.zeros_like(alive), alive, 0
            for p in range(len(slices) - 1, -1, -1):
                one = equal & slices[p]
                n = count(above) + count(one)
                if n >= k:
                    equal, boundary = one, boundary | 1 << p
                else:
                    above, equal = above | one, equal & ~slices[p]
            # what the dropped bits can add, in units of the slices
            slack = ((1 << DROPPED) - 1) * int(sum(abs(x) for x in query.tolist()))
            least = boundary - -(-slack >> DROPPED) - 1
            alive &= self._at_least(slices, least)
        rows = _rows(alive)
        score = self.exact(rows, query)
        order = sorted(range(len(rows)), key=lambda i: (-score[i], self.ids[rows[i]]))[:k]
        return rows[order], [score[i] for i in order]

    def _at_least(self, slices: list[np.ndarray], least: int) -> np.ndarray:
        if least <= 0:
            return np.full_like(self.rows, _FULL)
        if least.bit_length() > len(slices):
            return np.zeros_like(self.rows)
        above, equal = np.zeros_like(self.rows), np.full_like(self.rows, _FULL)
        for p in range(len(slices) - 1, -1, -1):
            if least >> p & 1:
                equal = equal & slices[p]
            else:
                above, equal = above | (equal & slices[p]), equal & ~slices[p]
        return above | equal

    def exact(self, rows: np.ndarray, query: np.ndarray) -> list[int]:
        """Integer inner products; beyond the range of a long the nearest long."""
        v = self.values[rows]
        size = float(np.abs(v.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(v.shape[1], 1)
        if size < 2.0**62:
            return (v @ query).tolist()
        sums = [sum(a * b for a, b in zip(r, query.tolist())) for r in v.tolist()]
        return [max(-(2**63), min(2**63 - 1, s)) for s in sums]


def _matrix(lists: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x[:dims]
    return out


# ------------------------------------------------------------------ operator
def top_k(vectors: DataFrame, queries: Column, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``queries`` holds, its ``k`` best other rows.

    Scores are integer inner products of ``floor(scale * x)``, ties go to the smaller id. Vectors that are null or hold a
    null, NaN or infinite component take no part. A missing component of a shorter vector counts as 0; equal vectors
    are separate rows. Rows with a null id take no part. Fewer rows than ``k``: all of them; no row gives no row.

    The rows become blocks of bit slices; runs of queries, about ``GROUP * GROUPS_A_ROW`` at most, meet every block, and
    only ``k`` rows per query and block are shuffled. A query's own row is left out by id. Other columns aren't read,
    whatever their names.
    """
    spark = vectors.sparkSession
    narrow = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    known = narrow.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q"), F.max(F.size("v")).alias("dims")
    ).first()
    blocks, groups, dims = max(1, -(-known.n // BLOCK_ROWS)), max(1, -(-known.q // GROUP)), known.dims or 0
    tasks = spark.sparkContext.defaultParallelism
    asked = (
        narrow.where("asks")
        .withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)))
        .groupBy("grp")
        .agg(F.collect_list(F.struct("id", "v")).alias("asked"))  # about GROUP rows each
    )
    part = narrow.withColumn("blk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))).groupBy("blk").agg(
        F.collect_list(F.struct("id", "v")).alias("held")  # about BLOCK_ROWS rows each
    )
    # every group visits every block, in runs: enough to keep all tasks busy, and none with more queries than a row should hold
    runs = max(1, min(groups, -(-2 * tasks // blocks)), -(-groups // GROUPS_A_ROW))
    held = part.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    visits = asked.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn(
        "run", (F.col("grp") % runs).cast("int")
    )
    asked_here = visits.groupBy("blk", "run").agg(F.flatten(F.collect_list("asked")).alias("asked"))
    return _best(held.join(asked_here, ["blk", "run"]), k, dims)


def _best(met: DataFrame, k: int, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, asked = batch.column("held")[i].values, batch.column("asked")[i].values
                ids, values = _unzip(held, dims)
                block = Block(ids, values)
                asked_ids, asked_values = _unzip(asked, dims)
                out: list[tuple] = []
                for q, x in zip(asked_ids.tolist(), asked_values):
                    rows, score = block.best(x, k, q)
                    out += [(q, int(block.ids[r]), s) for r, s in zip(rows, score)]
                cols = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = met.select("held", "asked").mapInArrow(run, "query_id long, vec_id long, score long")
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score")))
    ranked = found.groupBy("query_id").agg(F.slice(best, 1, k).alias("best"))
    out = ranked.select("query_id", F.posexplode("best").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _unzip(structs: pa.StructArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = structs.field("id").to_numpy(zero_copy_only=False)
    lists = structs.field("v")
    lengths = np.diff(lists.offsets.to_numpy())
    if len(lengths) and (lengths == dims).all():
        first, last = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
        return ids, lists.values.slice(first, last - first).to_numpy(zero_copy_only=False).reshape(-1, dims)
    return ids, _matrix(lists.to_pylist(), dims)
