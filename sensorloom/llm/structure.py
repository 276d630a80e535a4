"""Repair of the role structure of conversations by run-length dynamic programming.

A repaired conversation has the role initials ``(s?(ua)+)?``. Four states say what stands last: nothing, system, user,
assistant. A turn is a symbol, its role's initial and its fault; equal neighbours are one run. The transition of a symbol is
a 4 x 4 min-plus matrix, a run of n turns advances by cached binary powers of it, and choices are unrolled afterwards.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import durable, fresh
from sensorloom.llm.order import WHITE, in_order, runs, turn_digest

#: Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
DONE = (NOTHING, ASSISTANT)
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Texts of a repaired conversation that lies in several partitions travel in pieces of about so many bytes.
PIECE = 4 << 20
#: Rows of repeated turns that are sent to every task; more are joined by a shuffle.
SENT = 200_000


def new_turn(state: int) -> tuple[str, int]:
    """The role that an inserted or renamed turn gets, and the state after it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


@lru_cache(maxsize=None)
def inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = new_turn(state)[1]
    return state


#: Cost of a right end from each state, by inserts only, and the number of inserts.
ENDS = [min((INSERT * n, n) for n in range(3) if inserted(p, n) in DONE) for p in STATES]
END_COST = [c for c, _ in ENDS]


class Span:
    """Cheapest ways over some turns: ``cost[p][q]``, and the place of each way's letters among those from ``p``.

    Ways over the same turns end with an edit of a turn, so none is the beginning of another: the first letter that
    differs decides, and ranks of the halves order the wholes.
    """

    __slots__ = ("cost", "rank", "mid", "left", "right", "text")

    def __init__(self, cost, rank, mid=None, left=None, right=None, text=None):
        self.cost, self.rank, self.mid, self.left, self.right, self.text = cost, rank, mid, left, right, text

    def then(self, other: Span) -> Span:
        cost, mid, keys = [], [], []
        for p in STATES:
            best = [min((self.cost[p][m] + other.cost[m][q], self.rank[p][m], other.rank[m][q], m) for m in STATES) for q in STATES]
            cost.append([min(b[0], FAR) for b in best])
            mid.append([b[3] for b in best])
            keys.append([b[1:3] for b in best])
        return Span(cost, [_ranked(cost[p], keys[p]) for p in STATES], mid, self, other)

    def letters(self, p: int, q: int) -> str:
        """Unrolled choices of the way from ``p`` to ``q``."""
        out, todo = [], [(self, p, q)]
        while todo:
            span, a, b = todo.pop()
            if span.text is not None:
                out.append(span.text[a][b])
            else:
                m = span.mid[a][b]
                todo += [(span.right, m, b), (span.left, a, m)]
        return "".join(out)


def _ranked(cost: list[int], keys: list) -> list[int]:
    order = sorted(STATES, key=lambda q: (cost[q] >= FAR, keys[q]))
    return [order.index(q) for q in STATES]


@lru_cache(maxsize=None)
def single(symbol: str) -> Span:
    """One turn, with the inserts before it. Symbols: ``-`` must go; else an initial, upper-case where truncated."""
    extra = TRUNCATED if symbol.isupper() else 0
    cost, text = [[FAR] * 4 for _ in STATES], [["~"] * 4 for _ in STATES]
    for p in STATES:
        for n in range(3):
            at, before, paid = inserted(p, n), "I" * n, INSERT * n
            ways = [(paid + DELETE, before + "D", at)]
            if symbol != "-":
                if (at, symbol.lower()) in AFTER:
                    ways.append((paid + extra, before + "K", AFTER[at, symbol.lower()]))
                ways.append((paid + REROLE + extra, before + "R", new_turn(at)[1]))
            for c, letters, q in ways:
                cost[p][q], text[p][q] = min((cost[p][q], text[p][q]), (c, letters))
    return Span(cost, [_ranked(cost[p], text[p]) for p in STATES], text=text)


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> Span:
    """``2 ** k`` equal turns."""
    return single(symbol) if not k else power(symbol, k - 1).then(power(symbol, k - 1))


@lru_cache(maxsize=1024)
def run(symbol: str, n: int) -> Span:
    span = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            span = power(symbol, k) if span is None else span.then(power(symbol, k))
    return span


def spans(symbols: str) -> list[Span]:
    return [run(s, len(list(g))) for s, g in groupby(symbols)]


def joined(parts: list[Span]) -> Span | None:
    """All of them in a row, halved so that unrolling stays shallow."""
    while len(parts) > 1:
        parts = [a.then(b) for a, b in zip(parts[::2], parts[1::2])] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0] if parts else None


def behind(span: Span, after: list[int]) -> list[int]:
    """Least cost from each state before the span, if ``after`` has those behind it."""
    return [min(span.cost[p][q] + after[q] for q in STATES) for p in STATES]


def choose(span: Span, p: int, after: list[int]) -> int:
    return min(STATES, key=lambda q: (span.cost[p][q] + after[q], span.rank[p][q]))


def audit(symbols: str, state: int = NOTHING, after: list[int] | None = None) -> tuple[str, int]:
    """Letters of the cheapest edits, ASCII-least among equals, and the state behind the last turn."""
    parts = spans(symbols)
    costs = [END_COST if after is None else after]
    for span in reversed(parts):
        costs.append(behind(span, costs[-1]))
    letters = []
    for span, rest in zip(parts, reversed(costs[:-1])):
        q = choose(span, state, rest)
        letters.append(span.letters(state, q))
        state = q
    if after is None:
        letters.append("I" * ENDS[state][1])
    return "".join(letters), state


@dataclass
class Entry:
    """What a part of a conversation has to know of the others."""

    first: bool = True  # it begins here
    last: bool = True  # it ends here
    state: int = NOTHING
    after: list[int] | None = None
    before: tuple | None = None  # turn, initial and digest of the row before


@dataclass
class Part:
    """Rows of one conversation in one partition, after damage."""

    rows: list[tuple]  # (turn, role, text, digest)
    symbols: str
    faults: list[str | None]


def _part(table: pa.Table, seen: tuple | None = None) -> Part:
    """``seen``: turn and digest of the row before."""
    cols = [table.column(n).to_pylist() for n in ("turn", "role", "text", "digest", "far", "blank", "truncated", "gone")]
    rows, symbols, faults = [], [], []
    for turn, role, text, digest, far, blank, truncated, gone in zip(*cols):
        if gone:
            continue
        fault = "blank" if blank else "duplicate" if far or seen == (turn, digest) else "truncated" if truncated else None
        initial = role[:1] if role[:1] in {"s", "u", "a"} else "x"
        symbols.append("-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        rows.append((turn, role, text, digest))
        faults.append(fault)
        seen = (turn, digest)
    return Part(rows, "".join(symbols), faults)


def edited(part: Part, letters: str, state: int) -> Iterator[tuple]:
    """``(edit, turn, role, text, fault)`` in order; an inserted turn has an empty text, a deleted one its old role."""
    row = iter(zip(part.rows, part.faults))
    for letter in letters:
        if letter == "I":
            role, state = new_turn(state)
            yield letter, None, role, "", None
            continue
        (turn, role, text, _), fault = next(row)
        if letter == "K":
            state = AFTER[state, role[:1]]
        elif letter == "R":
            role, state = new_turn(state)
        yield letter, turn, role, text, fault


class Repair:
    """Repaired conversations of a table of turns.

    Turns are taken in the order of ``turn`` (null first), then of the MD5 of role and text; equal rows are neighbours. Null
    roles and texts are one space; any other initial than s, u, a (an empty role too) can't be kept. ``gone`` may name a
    boolean column with turns that are to be left out, while their conversation still is reported. A null conversation is
    one like others, repeated rows are duplicates, no row gives no row, other columns are ignored.

    Turns lie in ranges of (conversation, turn, MD5, row): a long conversation is spread over partitions. Each partition
    tells the min-plus matrix of its first and its last conversation; the driver, which gets two small rows a partition,
    knows then the state at every edge, and each partition unrolls its own choices. A task holds one conversation's rows
    of its own partition, texts of any length whole.
    """

    def __init__(self, turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None):
        self.kind = turns.schema[conv].dataType.simpleString()
        blank = F.lit(" ")
        rows = turns.select(
            F.col(conv).alias("conv_id"),
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role).cast("string"), blank).alias("role"),
            F.coalesce(F.col(text).cast("string"), blank).alias("text"),
            (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
        )
        end = F.rtrim(F.col("text"), F.lit(WHITE))
        rows = rows.withColumns(
            {
                "digest": turn_digest(F.col("role"), F.col("text")),
                "blank": end == "",
                "truncated": ~F.substring(end, -1, 1).isin(".", "!", "?"),
                "salt": F.monotonically_increasing_id(),  # parts equal rows only
            }
        )
        at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
        again = durable(
            rows.where("not gone")
            .groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
            .agg(F.min(at).alias("first"), F.max(at).alias("last"))
            .where("first < last")
            .select("c", "d", "first")
        )
        if again.count() <= SENT:
            again = F.broadcast(again)
        rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
        rows = rows.withColumn("far", F.coalesce(F.col("first") < at, F.lit(False))).drop("c", "d", "first")
        self.rows = in_order(rows, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "digest", "salt").drop("salt")
        self.entries = self._edges()

    def _edges(self) -> dict[tuple[int, bool], Entry]:
        """By partition and whether it is its first (else its last) conversation, if that lies in other partitions too."""

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pid, found, held = TaskContext.get().partitionId(), [], None
            for _, table in runs(batches, "conv_id"):
                if held is None:
                    found.append((True, table))
                held = table
            if held is None:
                return
            found.append((False, held))
            out = []
            for first, table in found:
                value, part = table.column("conv_id")[0].as_py(), _part(table)
                edge = {"pid": pid, "first": first, "one": held is found[0][1], "conv": None if value is None else str(value)}
                if part.rows:  # the row before may turn the first one into a duplicate
                    ways = [joined(spans(x + part.symbols[1:])) for x in (part.symbols[0], "-")]
                    edge |= {"ways": [(w.cost, w.rank) for w in ways], "rows": [(r[0], r[1][:1], r[3]) for r in (part.rows[0], part.rows[-1])]}
                out.append(json.dumps(edge))
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["edge"])

        slim = self.rows.select("conv_id", "turn", "role", F.lit("").alias("text"), "digest", "far", "blank", "truncated", "gone")
        found = (json.loads(r.edge) for r in slim.mapInArrow(ends, "edge string").collect())
        rows = sorted(found, key=lambda o: (o["pid"], not o["first"]))
        chains: list[list[dict]] = []  # parts of one conversation, partition after partition
        for o in rows:
            if o["one"] and not o["first"]:
                continue
            if chains and chains[-1][-1]["conv"] == o["conv"] and chains[-1][-1]["pid"] != o["pid"]:
                chains[-1].append(o)
            else:
                chains.append([o])
        entries: dict = {}
        for chain in (c for c in chains if len(c) > 1):
            entries.update(_chained(chain))
        return entries

    def turns(self) -> DataFrame:
        """One row an edit: ``conv_id``, ``part`` and ``place`` (order within the conversation), ``edit``, ``turn``, ``role``, ``text``, ``fault``."""
        entries = self.entries

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pid = TaskContext.get().partitionId()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            for value, kind, entry, part, letters in _parts(batches, entries):
                cols = list(zip(*((pid, i, *e) for i, e in enumerate(edited(part, letters, entry.state)))))
                if cols:
                    arrays = [pa.array([value] * len(cols[0]), type=kind), *[pa.array(c, type=k) for c, k in zip(cols, kinds)]]
                    yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "place", "edit", "turn", "role", "text", "fault"])

        return self.rows.mapInArrow(rows, f"conv_id {self.kind}, part long, place long, edit string, turn long, role string, text string, fault string")

    def conversations(self) -> DataFrame:
        """One row a conversation: counts, cost, audit and the SHA-256 of the repaired ``role:text`` lines."""
        entries = self.entries
        numbers = ["least", "most", "turns", "blank", "duplicate", "truncated", "illegal", "cost"]

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pid, held, kind = TaskContext.get().partitionId(), [], None

            def flush():
                cols = list(zip(*held))
                arrays = [pa.array(cols[0], type=kind), *[pa.array(c, type=pa.int64()) for c in cols[1:11]]]
                arrays += [pa.array(cols[11], type=pa.string()), pa.array(cols[12], type=pa.string()), pa.array(cols[13], type=pa.binary())]
                held.clear()
                return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "piece", *numbers, "audit", "digest", "body"])

            for value, kind, entry, part, letters in _parts(batches, entries):
                found = _counted(part, letters, entry)
                lines = (f"{role}:{text}".encode() for edit, _, role, text, _ in edited(part, letters, entry.state) if edit != "D")
                if entry.first and entry.last:
                    held.append((value, pid, 0, *found, letters, _sha(lines), None))
                else:
                    held.append((value, pid, 0, *found, letters, None, None))
                    for i, body in enumerate(_pieces(lines)):
                        held.append((value, pid, i + 1, None, None, *[0] * 6, "", None, body))
                        if len(body) >= PIECE:
                            yield flush()
                if len(held) >= 4096:
                    yield flush()
            if held:
                yield flush()

        sums = ", ".join(f"{n} long" for n in numbers)
        found = durable(self.rows.mapInArrow(totals, f"conv_id {self.kind}, part long, piece long, {sums}, audit string, digest string, body binary"))
        whole = found.where("digest is not null")
        split = found.where("digest is null")
        added = split.groupBy("conv_id").agg(
            F.min("least").alias("least"),
            F.max("most").alias("most"),
            *[F.sum(n).alias(n) for n in numbers[2:]],
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        )
        sha = (
            split.where("body is not null")
            .select("conv_id", "part", "piece", "body")
            .repartition("conv_id")
            .sortWithinPartitions("conv_id", "part", "piece")
            .mapInArrow(_hashed, f"c {self.kind}, digest string")
        )
        added = added.join(sha, F.col("conv_id").eqNullSafe(F.col("c")), "left").withColumn("digest", F.coalesce("digest", F.lit(_sha([]))))
        cols = ["conv_id", *numbers, "audit", "digest"]
        both = whole.select(*cols).unionByName(added.select(*cols))
        gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
        return both.select("conv_id", gaps, *numbers[3:], "audit", F.col("digest").alias("repaired_sha256"))


def _parts(batches: Iterator[pa.RecordBatch], entries: dict) -> Iterator[tuple]:
    """``(conversation, its type, entry, part, letters)`` of a partition."""
    pid, first, held = TaskContext.get().partitionId(), True, None

    def made(value, table, entry):
        part = _part(table, entry.before and (entry.before[0], entry.before[2]))
        letters, _ = audit(part.symbols, entry.state, None if entry.last else entry.after)
        return value, table.schema.field("conv_id").type, entry, part, letters

    for value, table in runs(batches, "conv_id"):
        if held is not None:
            yield made(*held, entries.get((pid, True), Entry()) if first else Entry())
            first = False
        held = value, table
    if held is not None:
        yield made(*held, entries.get((pid, first), Entry()))


def _chained(chain: list[dict]) -> dict[tuple[int, bool], Entry]:
    """Entries of the parts of one conversation."""
    whole, lows, low = [], [], None
    for o in chain:
        lows.append(low)
        if "ways" not in o:
            whole.append(None)
            continue
        top, end = map(tuple, o["rows"])
        whole.append(Span(*o["ways"][low is not None and (low[0], low[2]) == (top[0], top[2])]))
        low = end
    after = [END_COST]
    for span in reversed(whole[1:]):
        after.append(behind(span, after[-1]) if span else after[-1])
    after.reverse()
    entries, state = {}, NOTHING
    for i, (o, span, rest, low) in enumerate(zip(chain, whole, after, lows)):
        entries[o["pid"], o["first"]] = Entry(i == 0, i == len(chain) - 1, state, rest, low)
        if span:
            state = choose(span, state, rest)
    return entries


def _counted(part: Part, letters: str, entry: Entry) -> list:
    """Least and greatest turn, distinct turns that no part before has, faults, illegal neighbours, cost."""
    known = [r[0] for r in part.rows if r[0] is not None]
    distinct = len(set(known))
    initials = [r[1][:1] for r in part.rows]
    if entry.before:
        distinct -= entry.before[0] is not None and known[:1] == [entry.before[0]]
        initials.insert(0, entry.before[1])
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    left = [x for x in letters if x != "I"]
    paid = INSERT * (len(letters) - len(left)) + sum({"D": DELETE, "K": 0, "R": REROLE}[x] for x in left)
    paid += TRUNCATED * sum(f == "truncated" and x != "D" for x, f in zip(left, part.faults))
    return [min(known, default=None), max(known, default=None), distinct, *[part.faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, paid]


def _sha(lines) -> str:
    digest, first = hashlib.sha256(), True
    for line in lines:
        digest.update(line if first else b"\n" + line)
        first = False
    return digest.hexdigest()


def _pieces(lines) -> Iterator[bytes]:
    """The lines, each behind a line feed, in pieces."""
    held, size = [], 0
    for line in lines:
        held.append(b"\n" + line)
        size += len(line) + 1
        if size >= PIECE:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's pieces without the first line feed; one piece is in memory at a time."""
    value, digest, kind = None, None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([value], type=kind), pa.array([digest.hexdigest()])], names=["c", "digest"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for key, body in zip(batch.column("conv_id").to_pylist(), batch.column("body")):
            data = body.as_py()
            if digest is None or key != value:
                if digest is not None:
                    yield row()
                value, digest, data = key, hashlib.sha256(), data[1:]
            digest.update(data)
    if digest is not None:
        yield row()


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with planted faults by ``crc32('conv_id:turn') % 20``, and which of them are dropped."""
    lot, twice = fresh(turns, "lot"), fresh(turns, "twice")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.withColumn(lot, F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20)
    text = F.when(F.col(lot) == 1, "").when(F.col(lot) == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col(lot) == 4, "user").otherwise(said("role"))})
    rows = rows.withColumn(twice, F.explode(F.when(F.col(lot) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop(twice), F.col(lot) == 0
