"""I-Match fingerprints: hashes of a document's terms inside a band of inverse document frequency, for random parts of the lexicon."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import raw, slices, texts, with_columns

#: Signs that are cut off both ends of a term.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡"
#: Distinct terms of a slice of documents are counted together before they leave the task, about so many at a time.
COUNTED = 1 << 21


@dataclass(frozen=True)
class Band:
    """Terms of the lexicon: in at least ``rare`` and at most ``common`` of the documents, and in at least two.

    A document with t distinct terms has t (document, term) pairs, so no more than (mean t) / ``rare`` terms lie in the
    band, whatever the number of documents.
    """

    rare: float = 1 / 2000
    common: float = 1 / 8
    #: Share of the lexicon that each random part keeps. Large parts tell small edits, small parts large ones.
    keep: tuple[float, ...] = field(default=(1 / 2,) * 4 + (1 / 8,) * 4 + (1 / 32,) * 8 + (1 / 128,) * 8 + (1 / 512,) * 8)
    seed: int = 7


def term_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the distinct terms: lower-case words between blanks without signs at their ends."""
    words = set(text.lower().split())
    terms = {w if w.isalnum() else w.strip(EDGES) for w in words}
    terms.discard("")
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms], dtype=np.uint64)


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of hashes: the same for a term wherever it occurs."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Fingerprints:
    """Fingerprints against a lexicon: for each random part of it, a 64-bit hash of the sorted terms in that part; 0: none."""

    def __init__(self, lexicon: np.ndarray, band: Band):
        self.lexicon, self.band = np.sort(lexicon.astype(np.uint64)), band
        bits = np.zeros(len(self.lexicon), dtype=np.uint32)
        for k, share in enumerate(band.keep):
            kept = _mixed(self.lexicon, band.seed + k) < np.uint64(int(share * 2**64))
            bits |= kept.astype(np.uint32) << np.uint32(k)
        self.bits = bits

    def of(self, text: str) -> np.ndarray:
        """Where no term lies in the band, all terms of the document count; where it has none, all hashes are 0."""
        found = np.sort(term_hashes(text))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, found), len(self.lexicon) - 1)
            inside = self.lexicon[at] == found
        else:
            inside = np.zeros(len(found), dtype=bool)
        n = len(self.band.keep)
        if inside.any():
            found, bits = found[inside], self.bits[at[inside]]
            parts = [found[(bits >> np.uint32(k)) & np.uint32(1) > 0] for k in range(n)]
        else:
            parts = [found[_mixed(found, self.band.seed + k) < np.uint64(int(s * 2**64))] for k, s in enumerate(self.band.keep)]
        return np.array([xxhash.xxh3_64_intdigest(p.tobytes()) or 1 if len(p) else 0 for p in parts], dtype=np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the parts in which either document has a term; 1 for equal fingerprints, 0 beside an empty one."""
    some = (a > 0) | (b > 0)
    return float((a == b)[some].mean()) if some.any() else 1.0


def shown(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u8").tobytes().hex()


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term`` (hash) and ``n`` documents. Tasks count their own documents first, so that common terms leave as few rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

        for part in slices(batches):
            for t in texts(part):
                held.append(term_hashes(t))
                size += len(held[-1])
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "term long, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, band: Band | None = None, text: str = "text") -> Fingerprints:
    """The band's terms over all documents; the driver gets their hashes, whose number ``Band`` bounds."""
    band = band or Band()
    n = docs.count()
    least, most = max(2, math.ceil(n * band.rare)), max(2, math.floor(n * band.common))
    terms = document_frequencies(docs, text).where(F.col("n").between(least, most)).select("term").toArrow()
    return Fingerprints(terms.column("term").to_numpy().view(np.uint64), band)


def fingerprints(docs: DataFrame, found: Fingerprints, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and a column ``name`` (binary, 8 bytes a part of the lexicon), without a shuffle."""
    if name in docs.columns:
        raise ValueError(f"{name} is taken")
    held = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for part in slices(batches, text):
            yield with_columns(part, set(), **{name: pa.array([own.of(t).tobytes() for t in texts(part, text)], type=pa.binary())})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{name}` binary")


def _blocks(docs: DataFrame, parts: int) -> list[int]:
    """Ids that part the documents into blocks of about equal size."""
    shares = [k / parts for k in range(1, parts)]
    row = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(max(10_000, 4 * parts))).alias("q")).first() if shares else None
    return sorted(set(row.q)) if row and row.q else []


def beside_next(docs: DataFrame, found: Fingerprints) -> DataFrame:
    """``docs(doc_id long, text)`` with the likeness of each document to an edited text and to the next document.

    The next document has the next greater id (null first; equal ids by text); behind the last one comes the first. The edited
    text has the last half of its code points (rounded down) replaced by as many from the beginning of the next document.

    Blocks of consecutive ids are worked on apart. Each also gets the first document of the next block, and the last block
    that of the first: texts are shuffled once, without an order over all rows in one task. Documents with one id share a
    block. A null text is empty; equal rows follow each other; one document alone follows itself; no row gives no row.
    """
    edges = np.array(_blocks(docs, max(1, docs.rdd.getNumPartitions())), dtype=np.int64)

    def block(ids: pa.Array) -> np.ndarray:
        out = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right") + 1
        out[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return out

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict = {}
        for batch in batches:
            ids = batch.column("doc_id")
            own = ids.fill_null(0).to_numpy(zero_copy_only=False)
            at = block(ids)
            for b in np.unique(at).tolist():
                first = int(own[at == b].min())
                low[b] = min(low.get(b, first), first)
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(low.keys(), type=pa.int64()), pa.array(low.values(), type=pa.int64())], names=["block", "low"])

    rows = docs.select("doc_id").mapInArrow(least, "block long, low long").groupBy("block").agg(F.min("low").alias("low")).collect()
    heads = dict(sorted((r.block, r.low) for r in rows))
    before = dict(zip(heads, [max(heads, default=0), *heads]))  # the block that a block's first document goes to as well
    held = docs.sparkSession.sparkContext.broadcast(found)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for part in slices(batches):
            ids = part.column("doc_id")
            at, values = block(ids), ids.fill_null(0).to_numpy(zero_copy_only=False)
            prints = pa.array([own.of(t).tobytes() for t in texts(part)], type=pa.binary())
            extra = np.flatnonzero(np.array([heads[b] == v for b, v in zip(at.tolist(), values.tolist())], dtype=bool))
            take = np.concatenate([np.arange(len(at)), extra])
            behind = np.arange(len(take)) >= len(at)
            where = np.concatenate([at, [before[b] for b in at[extra].tolist()]]).astype(np.int64)
            columns = [pa.array(where), pa.array(behind), *(c.take(pa.array(take)) for c in (ids, part.column("text"), prints))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "behind", "doc_id", "text", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, done = held.value, None, None
        for part in slices(batches):
            out = []
            cols = (part.column(n).to_pylist() for n in ("block", "behind", "doc_id", "fp"))
            for b, behind, key, data, t in zip(*cols, raw(part)):
                row = (b, key, t.decode("utf-8", "replace"), np.frombuffer(data, dtype=np.uint64))
                if last is not None and last[0] == b and done != b:
                    out.append(_compared(own, last, row))
                if behind:
                    done = b  # only the first of the rows behind a block is next
                last = None if behind else row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[f.split()[0] for f in COMPARED.split(", ")])

    spread = docs.mapInArrow(dealt, "block long, behind boolean, doc_id long, text string, fp binary")
    near = spread.repartition("block").sortWithinPartitions("block", "behind", F.col("doc_id").asc_nulls_first(), "text")
    return near.mapInArrow(compared, COMPARED)


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _compared(own: Fingerprints, row: tuple, following: tuple) -> tuple:
    _, key, text, fp = row
    half = len(text) // 2
    edited = text[: len(text) - half] + following[2][:half]
    new = own.of(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return key, len(text), digest, shown(fp), shown(new), likeness(fp, new), likeness(fp, following[3])
