"""SimHash near-duplicates: fingerprints, a grid join on segment popcounts, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sensorloom.functions.names import col
from sensorloom.llm.common import durable, fresh, raw, slices, with_columns
from sensorloom.llm.graph import components

SEED = 42
#: Bits of one segment of the popcount embedding; 32 segments in two halves of 16.
SEGMENT = 2
_LOW = np.uint64(0x5555555555555555)
_HALF = np.uint64(0xFFFFFFFF)
#: Rows of a list of ids that are sent to every task; longer lists are joined by a shuffle.
SENT = 500_000


def fingerprint(text: bytes, shingle: int) -> int:
    """64 majority bits over the XXH64 of all word shingles of one text, repeats included; 0 without a word.

    Letters A-Z are lowered, words are parted by ASCII blanks (``bytes.lower`` and ``bytes.split`` do just that).
    """
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(b" ".join(words), SEED)], dtype="<u8")
    else:
        joined = words
        for k in range(1, shingle):
            joined = [a + b" " + b for a, b in zip(joined, words[k:])]
        hashes = np.fromiter((digest(s, SEED) for s in joined), dtype="<u8", count=len(joined))
    set_bits = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        octets = hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(
    docs: DataFrame, name: str, *, text: str = "text", shingle: int = 3, keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) and the fingerprint as a long (two's complement)."""
    carried = fresh(docs, "fp_text")
    kept = docs.select(*[col(c) for c in (docs.columns if keep is None else keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, carried):
            marks = np.array([fingerprint(t, shingle) for t in raw(part, carried)], dtype="<u8").view("<i8")
            yield with_columns(part, {carried}, **{name: pa.array(marks, type=pa.int64())})

    schema = StructType([*kept.schema.fields, StructField(name, LongType())])
    given = docs.select(*[col(c) for c in kept.columns], col(text).cast("string").alias(carried))
    return given.mapInArrow(run, schema)


def _grid(radius: int):
    """Rows ``(cell, home, fp)`` of each fingerprint: its own cell in both halves and all cells within ``radius`` of it.

    A fingerprint is embedded as the popcounts of its 32 two-bit segments. The Manhattan distance of two embeddings is
    at most their bit distance, so where the bit distance is at most ``2 * radius + 1``, one half of the segments
    differs by ``radius`` or less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                fp = batch.column("fp").slice(a, 8192).to_numpy(zero_copy_only=False)
                bits = fp.view(np.uint64)
                counts = (bits & _LOW) + ((bits >> np.uint64(1)) & _LOW)  # 32 fields of two bits, each 0 to 2
                cells, homes, owners = [], [], []
                for half in (0, 1):
                    own = ((counts >> np.uint64(32 * half)) & _HALF).astype(np.int64)
                    layer, seen_by = own, np.arange(len(own))
                    found_cell, found_by = [own], [seen_by]
                    for _ in range(radius):
                        grown_cell, grown_by = [], []
                        for field in range(16):
                            step = np.int64(1) << np.int64(2 * field)
                            value = (layer >> np.int64(2 * field)) & 3
                            for ok, sign in ((value < SEGMENT, 1), (value > 0, -1)):
                                grown_cell.append(layer[ok] + sign * step)
                                grown_by.append(seen_by[ok])
                        layer, seen_by = np.concatenate(grown_cell), np.concatenate(grown_by)
                        pairs = np.unique(np.stack([seen_by, layer]), axis=1) if radius > 1 else np.stack([seen_by, layer])
                        seen_by, layer = pairs
                        found_cell.append(layer)
                        found_by.append(seen_by)
                    cell, by = np.concatenate(found_cell), np.concatenate(found_by)
                    if radius > 1:
                        by, cell = np.unique(np.stack([by, cell]), axis=1)
                    tag = np.int64(half) << np.int64(32)
                    cells += [own | tag, cell | tag]
                    owners += [fp, fp[by]]
                    homes += [np.ones(len(own), bool), np.zeros(len(cell), bool)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes)), pa.array(np.concatenate(owners))],
                    names=["cell", "home", "fp"],
                )

    return run


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``(a, b)``, each once, of distinct fingerprints ``fp`` that differ in 1 to ``max_bits`` bits.

    The cell of one fingerprint meets the neighbouring cells of the other; inside a cell the bit distance is taken
    exactly, as a condition of the join. Only linked pairs leave it. A crowded cell is split by the engine's skew join.
    """
    grid = prints.mapInArrow(_grid(max_bits // 2), "cell long, home boolean, fp long")
    home = grid.where("home").select("cell", F.col("fp").alias("a"))
    near = grid.where("not home").select("cell", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return home.join(near, (home.cell == near.cell) & close).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3, also: str | None = None
) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id, root)`` for each row: its fingerprint and its near-duplicate component.
    ``also`` may name one more column to carry.

    Rows with one fingerprint are one node of the link graph, however many there are; links join distinct
    fingerprints. ``component_id`` is the smallest id in the component, ``root`` its smallest fingerprint.

    A null or blank text has fingerprint zero and is linked like any other. A null id never is a component's id
    unless all its ids are null. Equal rows each give a row. An empty table gives none. Other columns are ignored.
    """
    more = [also] if also else []
    narrow = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), *[col(c) for c in more])
    marked = durable(with_fingerprint(narrow, "fp", shingle=shingle, keep=["doc_id", *more]))
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), max_bits))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(ids, "root").select("fp", "root", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(classes, "fp").select("doc_id", "fp", hexed, "component_id", "root", *[col(c) for c in more])


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each near-duplicate component, all columns: the one with the smallest id.

    Ties of an id go to the smaller fingerprint, then to the smaller hash of the text; of rows with one id and one text one
    stays. Rows without an id stay only where their component has no id. Texts are read twice, for the fingerprints and for
    the result: what goes is known by id and hash, so that texts are shuffled only where that list is too long to be sent.
    """
    mark = fresh(docs, "kept_hash")
    body = col(text).cast("string")
    marked = docs.withColumn(mark, F.xxhash64(body, F.length(body)))
    found = near_duplicates(marked, doc_id=doc_id, text=text, shingle=shingle, max_bits=max_bits, also=mark)
    found = durable(found.select("doc_id", "fp", "root", col(mark).alias("mark")))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fp"), F.col("mark"))
    best = found.groupBy("root").agg(F.min(order).alias("w")).select("root", F.col("w.doc_id").alias("best_id"), F.col("w.mark").alias("best_mark"))
    judged = found.join(best, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark")))
    go = durable(judged.where("not stays").select("doc_id", "mark").distinct())
    again = durable(judged.where("stays").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark"))
    kept = marked.join(_sent(go), _same(marked, go, doc_id, mark), "left_anti")
    if not again.isEmpty():
        twice = kept.join(_sent(again), _same(kept, again, doc_id, mark), "left_semi").dropDuplicates([doc_id, mark])
        kept = kept.join(_sent(again), _same(kept, again, doc_id, mark), "left_anti").unionByName(twice)
    return kept.select(*[col(c) for c in docs.columns])


def _sent(rows: DataFrame) -> DataFrame:
    """Sent to every task where its counted rows allow it."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _same(rows: DataFrame, named: DataFrame, doc_id: str, mark: str):
    return rows[f"`{doc_id}`"].eqNullSafe(named.doc_id) & (rows[f"`{mark}`"] == named.mark)
