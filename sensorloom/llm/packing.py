"""Vector bin packing of tokenised documents under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import slices, texts
from sensorloom.llm.tokens import byte_level

SCHEMA = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)


@dataclass
class Limits:
    """Of one sequence; a document longer than one of them is cut."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Packer:
    """Packs the pieces of one partition.

    A piece has the demand vector (tokens, 1 segment, loss-bearing tokens). One sequence is open at a time; of the
    waiting pieces that fit, it takes the one whose demand has the largest dot product with the room that is left, both in
    shares of the limits. Where none fits, the one with the largest product is cut to the room. A sequence that ends
    before it is full (the segment limit, the last of a partition) is cut back to a power of two.
    """

    WAITING = 256  # sequences' worth of tokens that wait at most

    def __init__(self, limits: Limits, first: int):
        self.lim, self.next_id, self.out, self.held = limits, first, [], 0
        self.pool: dict[tuple[int, int], list[tuple]] = {}  # by (tokens, loss): (doc, ids, start, end, loss_from)

    def add(self, doc, ids: np.ndarray, loss_from: int) -> None:
        start, n, lim = 0, len(ids), self.lim
        while n - start >= lim.tokens and self._loss(start, start + lim.tokens, loss_from) <= lim.loss:
            self._emit([(doc, ids, start, start + lim.tokens, loss_from)])
            start += lim.tokens
        while start < n:  # shorter, or with more loss-bearing tokens than one sequence may hold
            end = min(n, start + lim.tokens, max(start, loss_from) + lim.loss)
            self._wait((doc, ids, start, end, loss_from))
            start = end
        if self.held >= self.WAITING * lim.tokens:
            self.pack(lim.tokens * self.WAITING // 4)

    @staticmethod
    def _loss(start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def _wait(self, piece: tuple) -> tuple[int, int]:
        need = piece[3] - piece[2], self._loss(*piece[2:])
        self.pool.setdefault(need, []).append(piece)
        self.held += need[0]
        return need

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, ids, start, end, loss_from in pieces:
            crc = zlib.crc32(ids[start:end].tobytes())
            self.out.append((doc, start, end - start, crc, len(ids), self.next_id, at, self._loss(start, end, loss_from)))
            at += end - start
        self.next_id += 1

    def pack(self, keep: int = 0) -> None:
        """Close sequences until at most ``keep`` tokens wait.

        Pieces with one demand are alike, so a pick looks at the demands that wait, not at the pieces: there are at most as
        many as fit into the waiting tokens, however short the documents.
        """
        lim, needs = self.lim, list(self.pool)
        size = np.array([n[0] for n in needs], dtype=np.float64)
        loss = np.array([n[1] for n in needs], dtype=np.float64)
        left = np.array([len(self.pool[n]) for n in needs])
        while self.held > keep:
            room, seg, room_loss, chosen = lim.tokens, lim.segments, lim.loss, []
            while room > 0 and seg > 0:
                worth = size * (room / lim.tokens**2) + loss * (room_loss / max(lim.loss, 1) ** 2) + seg / lim.segments**2
                worth[left == 0] = -1
                fits = np.where((size <= room) & (loss <= room_loss), worth, -1)
                k = int(fits.argmax()) if len(fits) else -1
                whole = k >= 0 and fits[k] >= 0
                if not whole:
                    k = int(worth.argmax()) if len(worth) else -1
                    if k < 0 or worth[k] < 0:
                        break
                piece = self.pool[needs[k]][-1]
                doc, ids, start, end, loss_from = piece
                mid = end if whole else min(end, start + room, max(start, loss_from) + room_loss)
                if mid <= start:
                    break
                self.pool[needs[k]].pop()
                left[k] -= 1
                self.held -= end - start
                if mid < end:
                    needs, size, loss, left = self._again((doc, ids, mid, end, loss_from), needs, size, loss, left)
                    piece = (doc, ids, start, mid, loss_from)
                room -= mid - start
                seg -= 1
                room_loss -= self._loss(*piece[2:])
                chosen.append(piece)
            used = lim.tokens - room
            spare = used - (1 << (used.bit_length() - 1)) if room else 0
            while spare:  # cut back; what is cut off waits again
                doc, ids, start, end, loss_from = chosen.pop()
                cut = max(start, end - spare)
                spare -= end - cut
                if cut > start:
                    chosen.append((doc, ids, start, cut, loss_from))
                needs, size, loss, left = self._again((doc, ids, cut, end, loss_from), needs, size, loss, left)
            self._emit(chosen)
        self.pool = {n: p for n, p in self.pool.items() if p}

    def _again(self, piece: tuple, needs: list, size: np.ndarray, loss: np.ndarray, left: np.ndarray) -> tuple:
        need = self._wait(piece)
        if need in needs:
            left[needs.index(need)] += 1
            return needs, size, loss, left
        return [*needs, need], np.append(size, need[0]), np.append(loss, need[1]), np.append(left, 1)

    def rows(self) -> list[tuple]:
        done, self.out = self.out, []
        return done


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    prompt_tokens: str | None = None,
    limits: Limits | None = None,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Ids are those of the ``tokenizers`` file at ``tokenizer`` plus ``end_id``. ``prompt_tokens`` may name a column with the
    number of leading ids that bear no loss (null: none). Each partition packs its own rows without a shuffle: a map task
    that is run again gives the same sequences, and what waits in memory is bounded. Sequences hold ``limits.tokens``
    ids, or, at the segment limit and at the end of a partition, a power of two, so that none needs padding.

    A null text is an empty one and gives one piece with the end id; a null id stays null; equal rows are packed once
    each; no row gives no row. A very long text is encoded whole and cut into full sequences; ties between demands go to the
    one that has waited longest, within a demand to the latest piece. Other columns, whatever their names, are ignored.
    """
    lim = limits or Limits()
    if lim.tokens & (lim.tokens - 1) or min(lim.tokens, lim.segments, lim.loss) < 1:
        raise ValueError("limits are positive and the token limit is a power of two")
    lead = F.col(prompt_tokens).cast("long") if prompt_tokens else F.lit(0).cast("long")
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(tokenizer)
        packer = Packer(lim, TaskContext.get().partitionId() << 40)
        id_type = None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*packer.rows()))
            arrays = [pa.array(cols[0], type=id_type), *[pa.array(c, type=pa.int64()) for c in cols[1:]]]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for part in slices(batches):
            id_type = part.column("doc_id").type
            for key, t, lead_ids in zip(part.column("doc_id").to_pylist(), texts(part), part.column("lead").to_pylist()):
                own = np.append(encoder.one(t), np.uint32(end_id)).astype("<u4", copy=False)
                packer.add(key, own, min(max(lead_ids or 0, 0), len(own)))
            if packer.out:
                yield batch()
        packer.pack()
        if packer.out:
            yield batch()

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), lead.alias("lead"))
    return narrow.mapInArrow(run, SCHEMA.format(id=kind))
