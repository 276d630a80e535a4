"""Prefix trie of conversations from sorted sequences: sparse tables over the LCPs give the members of every prefix.

Distinct sequences of turns are sorted; ``lcp[i]`` is the number of turns that sequence ``i`` shares with the one before.
The sequences that begin with the first ``d`` turns of sequence ``i`` are an interval around it. Its left and its right end
are found independently of all others, by binary search over range minima of the LCPs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import durable
from sensorloom.llm.order import in_order, turn_digest, word_count

#: Bytes of the digest that stands for a turn.
WIDTH = 16
#: Prefixes that are worked on at a time.
AT_ONCE = 1 << 17
#: Prefixes over several partitions that are sent to every task; more are joined by a shuffle.
SENT = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


class RangeMinimum:
    """Sparse table: minima of all runs of a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (step := 1 << len(self.rows)) <= len(values):
            low = self.rows[-1]
            self.rows.append(np.minimum(low[: len(values) - step + 1], low[step // 2 :][: len(values) - step + 1]))

    def minimum(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each run, both ends included."""
        out = np.empty(len(first), dtype=self.rows[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << int(k)) + 1])
        return out

    def right(self, i: np.ndarray, least: np.ndarray, end: int) -> np.ndarray:
        """The furthest ``r`` up to ``end`` with all of ``values[i + 1 .. r]`` at ``least`` or above."""
        at = i.copy()
        for k in reversed(range(len(self.rows))):
            ok = at + (1 << k) <= end
            ok[ok] = self.rows[k][at[ok] + 1] >= least[ok]
            at[ok] += 1 << k
        return at

    def left(self, i: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least ``l`` with all of ``values[l + 1 .. i]`` at ``least`` or above."""
        at = i.copy()
        for k in reversed(range(len(self.rows))):
            ok = at - (1 << k) >= 0
            ok[ok] = self.rows[k][at[ok] - (1 << k) + 1] >= least[ok]
            at[ok] -= 1 << k
        return at


def shared(a: bytes | None, b: bytes | None) -> int:
    """Number of turns that two sequences begin with in common; -1 beside a missing one."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // WIDTH


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


class Slice:
    """Nodes of one partition of the sorted sequences; ``low`` and ``high`` are the LCPs over its edges."""

    FIELDS = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends", "node", "parent"]

    def __init__(self, keys: list[bytes], convs, copies, words: list[np.ndarray], ends: list[str], low: int, high: int):
        self.keys, self.ends, n = keys, ends, len(keys)
        self.size = np.array([len(k) // WIDTH for k in keys], dtype=np.int64)
        lcp = [low, *map(shared, keys, keys[1:]), high]
        self.lcp, self.n = np.array(lcp, dtype=np.int64), n
        self.table, self.convs = RangeMinimum(self.lcp), RangeMinimum(np.asarray(convs, dtype=np.int64))
        copies = np.asarray(copies, dtype=np.int64)
        self.total = np.array([w.sum() for w in words], dtype=np.int64)
        self.upto = _sums(np.concatenate(words) if words else np.zeros(0, np.int64))  # words before each turn, all sequences in a row
        self.begin = _sums(self.size)
        self.known = np.maximum(self.lcp[:-1], 0)  # depth that is not new at a sequence
        self.n_copies, self.n_words, self.n_leaves = _sums(copies), _sums(copies * self.total), _sums(self.lcp[1:] < self.size)
        self.n_own = _sums(self.total - self._before(np.arange(n), self.known))
        self.first = _sums(self.size - self.known)  # number of a sequence's first new node
        self.children = np.zeros(self.first[-1], dtype=np.int64)
        self.open_children = np.zeros(max(low, 0) + 1, dtype=np.int64)  # of prefixes that began before this partition
        self.digests: dict = {}
        self._count_children()

    def _before(self, i: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Words in the first ``turns`` turns of sequences ``i``."""
        return self.upto[self.begin[i] + turns] - self.upto[self.begin[i]]

    def _count_children(self) -> None:
        self.children[1:] += np.diff(np.repeat(np.arange(self.n), np.diff(self.first))) == 0  # the next depth of one sequence
        self.children[:-1], self.children[-1:] = self.children[1:].copy(), 0
        tops = np.flatnonzero(self.size > self.known)
        depth = self.known[tops]
        self.top_left = np.zeros(self.n, dtype=np.int64)
        at = self.table.left(tops, depth)
        self.top_left[tops] = at
        opened = (depth == 0) | ((at == 0) & (self.lcp[0] >= depth))
        np.add.at(self.open_children, depth[opened], 1)
        at, depth = at[~opened], depth[~opened]
        np.add.at(self.children, self.first[at] + depth - self.known[at] - 1, 1)

    def _node(self, side: int, depth: int) -> bytes:
        """What names a prefix in other partitions: a digest of it, from the first or the last sequence."""
        if (side, depth) not in self.digests:
            self.digests[side, depth] = hashlib.md5(self.keys[side][: depth * WIDTH]).digest()
        return self.digests[side, depth]

    def _open(self, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return (depth == 0) | ((left == 0) & (self.lcp[0] >= depth)) | ((right == self.n - 1) & (self.lcp[-1] >= depth))

    def new(self) -> Iterator[list[list]]:
        """Prefixes that no sequence before has, in blocks of columns."""
        start = 0
        while start < self.n:
            stop = max(start + 1, int(np.searchsorted(self.first, self.first[start] + AT_ONCE, "right")) - 1)
            i = np.repeat(np.arange(start, stop), np.diff(self.first[start : stop + 1]))
            start = stop
            if len(i):
                yield self._block(i, np.arange(len(i)) + self.first[i[0]] - self.first[i] + self.known[i] + 1)

    def _block(self, i: np.ndarray, depth: np.ndarray) -> list[list]:
        left, right = self.table.left(i, depth), self.table.right(i, depth, self.n - 1)
        conv = self.convs.minimum(left, right)
        copies = self.n_copies[right + 1] - self.n_copies[left]
        before = self._before(i, depth - 1)
        saved = self.n_words[right + 1] - self.n_words[left] - copies * before
        saved -= self.total[i] - before + self.n_own[right + 1] - self.n_own[i + 1]
        leaves = self.n_leaves[right + 1] - self.n_leaves[left]
        children = self.children[self.first[i] + depth - self.known[i] - 1]
        opened = self._open(left, right, depth)
        top = depth == self.known[i] + 1  # else the parent is the row before
        up_left, up_depth = self.top_left[i[top]], depth[top] - 1
        up_right = self.table.right(i[top], up_depth, self.n - 1)
        up = np.concatenate([[0], conv[:-1]])
        up[top] = self.convs.minimum(up_left, up_right)
        up_open = np.concatenate([[False], opened[:-1]])
        up_open[top] = self._open(up_left, up_right, up_depth)
        up_side = np.full(len(i), self.n - 1)
        up_side[top] = np.where((up_left == 0) & (self.lcp[0] >= up_depth), 0, self.n - 1)
        ended = depth == self.size[i]
        node = [self._node(self.n - 1, b) if o else None for b, o in zip(depth.tolist(), opened.tolist())]
        parent = [self._node(a, b - 1) if o else None for a, b, o in zip(up_side.tolist(), depth.tolist(), up_open.tolist())]
        ends = [self.ends[a] if e else None for a, e in zip(i.tolist(), ended.tolist())]
        up_conv = [None if o else c for c, o in zip(up.tolist(), up_open.tolist())]
        return [conv.tolist(), depth.tolist(), up_conv, *(x.tolist() for x in (copies, children, leaves, saved)), ends, node, parent]

    def shares(self) -> list[list]:
        """What this partition adds to the root and to prefixes that began before it."""
        depth = np.arange(0, max(int(self.lcp[0]), 0) + 1)
        zero = np.zeros(len(depth), dtype=np.int64)
        right = self.table.right(zero, depth, self.n - 1)
        right[0] = self.n - 1
        copies = self.n_copies[right + 1]
        saved = self.n_words[right + 1] - copies * self._before(zero, np.maximum(depth - 1, 0)) - self.n_own[right + 1]
        conv, leaves = self.convs.minimum(zero, right), self.n_leaves[right + 1]
        node = [self._node(0, d) for d in depth.tolist()]
        ends: list = [None] * len(depth)
        if not self.size[0]:
            ends[0] = self.ends[0]  # turnless conversations
        columns = [x.tolist() for x in (copies, self.open_children, leaves, saved)]
        return [conv.tolist(), depth.tolist(), [None] * len(depth), *columns, ends, node, [None, *node[:-1]]]


SCHEMA = (
    "conv long, depth long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string, node binary, parent binary"
)
_KINDS = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each sequence, in order; only the hash of the current one is in memory."""
    name, digest, out = None, None, []
    for batch in batches:
        for key, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()):
            if key != name:
                if name is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = key, hashlib.sha256(str(conv).encode())
            else:
                digest.update(b",%d" % conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["s", "ends"])
            out = []
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["s", "ends"])


def _distinct(sequences: DataFrame) -> DataFrame:
    """One row a sequence: ``key, words, conv`` (least id), ``copies``, ``ends``. Copies meet as counts; their ids meet
    only for the hash, two short values a row."""
    named = durable(sequences.withColumn("seq", F.md5("key")))
    found = named.groupBy("seq").agg(
        F.min("conv_id").alias("conv"), F.count("*").alias("copies"), F.first("key").alias("key"), F.first("words").alias("words")
    )
    found = durable(found)
    # durable: right behind a join on the same column, the planner may leave the repartition out
    ids = durable(named.select("seq", "conv_id").join(found.where("copies > 1").select("seq"), "seq", "left_semi"))
    ends = ids.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_hashed, "s string, ends string")
    alone = F.sha2(F.col("conv").cast("string"), 256)
    return found.join(ends, F.col("seq") == F.col("s"), "left").select("key", "words", "conv", "copies", F.coalesce("ends", alone).alias("ends"))


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences(conv_id long, key binary, words array<long>)``: 16 bytes and one number a turn.

    Sequences are dealt by ranges, so that one prefix, however common, is spread over partitions. A partition holds its own
    sequences; of prefixes that reach over its edges (at most as many as its first and its last sequence have turns) it
    gives shares, which are added up. Equal sequences are one row with a count. No row: no node.
    """
    rows = in_order(_distinct(sequences), "key")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column("key")[0].as_py() if first is None else first
                last = batch.column("key")[batch.num_rows - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first]), pa.array([last])], names=["p", "a", "z"])

    found = sorted(rows.select("key").mapInArrow(edges, "p long, a binary, z binary").collect(), key=lambda r: r.p)
    low: dict[int, int] = {}
    high: dict[int, int] = {}
    for a, b in zip([None, *found], [*found, None]):
        both = shared(a and bytes(a.z), b and bytes(b.a))
        if a:
            high[a.p] = both
        if b:
            low[b.p] = both

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        pid, t = TaskContext.get().partitionId(), pa.Table.from_batches(own)
        words = [np.asarray(w, dtype=np.int64) for w in t.column("words").to_pylist()]
        part = Slice(t.column("key").to_pylist(), t.column("conv"), t.column("copies"), words, t.column("ends").to_pylist(), low[pid], high[pid])
        for block in chain([part.shares()], part.new()):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(block, _KINDS)], names=Slice.FIELDS)

    every = durable(rows.mapInArrow(nodes, SCHEMA))
    opened = durable(
        every.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("conv").alias("conv"),
            F.max("depth").alias("depth"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
            F.max("ends").alias("ends"),
            F.max("parent").alias("parent"),
        )
    )
    columns = ["conv", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends", "parent"]
    both = every.where("node is null").select(*columns, "parent_conv").unionByName(opened.select(*columns, F.lit(None).cast("long").alias("parent_conv")))
    above = opened.select(F.col("node").alias("up"), F.col("conv").alias("up_conv"))
    if opened.count() <= SENT:
        above = F.broadcast(above)
    both = both.join(above, F.col("parent") == F.col("up"), "left")
    return both.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.coalesce("parent_conv", "up_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, t``: each conversation's turns in order, as digest and number of words. One row a conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).isNotNull().alias("known"),
        F.col(turn).cast("long").alias("turn"),
        turn_digest(said(role), said(text)).alias("digest"),
        word_count(said(text)).alias("words"),
    )
    order = F.sort_array(F.collect_list(F.struct("known", "turn", "digest", "words")))
    return rows.groupBy("conv_id").agg(F.transform(order, lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("t"))


def _sequences(rows: DataFrame, turns: Column) -> DataFrame:
    key = F.unhex(F.array_join(F.transform(turns, lambda x: x["digest"]), ""))
    return rows.select("conv_id", key.alias("key"), F.transform(turns, lambda x: x["words"]).alias("words"))


def prefix_trie(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Trie of the conversations of a table of turns, one row a node.

    Turns are in the order of ``turn`` (null first), then of the MD5 of role and text; a null role or text is empty. Rows
    without a conversation id take no part. Equal rows are turns of their own. Texts are read whole and become digests; a
    conversation is one row of 16 bytes a turn. Other columns are ignored; no row gives no node.
    """
    rows = _turns(turns, conv, turn, role, text)
    return prefix_nodes(_sequences(rows, F.col("t")))


def with_shared_beginnings(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Conversations rebuilt so that prefixes are shared: the first ``crc32(id) % heads`` turns come from the first of a block of ids."""
    rows = durable(_turns(turns, "conv_id", "turn", "role", "text"))
    base = F.col("conv_id") - F.col("conv_id") % block
    firsts = rows.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, heads - 1).alias("lead"))
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    rows = rows.withColumns({"own": own.cast("int"), "at": base}).join(firsts, F.col("at") == F.col("base"), "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("own")), F.slice("t", F.lit(1), F.lit(0)))
    return _sequences(rows, F.concat(lead, F.slice("t", F.col("own") + 1, F.greatest(F.size("t"), F.lit(1)))))
