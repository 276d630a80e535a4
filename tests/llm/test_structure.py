import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import structure
from sensorloom.llm.structure import Repair, audit, damaged

COLUMNS = "conv_id long, turn long, role string, text string, cost string, digest string"
GO = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def inserts(ways):
    """Ways ``{last initial: (cost, letters, lines)}`` after up to three inserts."""
    out = dict(ways)
    for _ in range(3):
        for last, (cost, letters, lines) in list(out.items()):
            role = "assistant" if last == "u" else "user"
            new = (cost + 2, letters + "I", [*lines, f"{role}:"])
            out[role[0]] = min(out.get(role[0], new), new)
    return out


def plain(rows):
    """The whole conversation row by row, with every way spelled out."""
    ways, seen, counts, initials = {"": (0, "", [])}, set(), dict(blank=0, duplicate=0, truncated=0), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        initials.append(role[:1])
        if fault:
            counts[fault] += 1
        new = {}
        for last, (cost, letters, lines) in inserts(ways).items():
            options = [(last, (cost + 3, letters + "D", lines))]
            if fault in (None, "truncated"):
                extra = fault == "truncated"
                if role[:1] in GO[last]:
                    options.append((role[:1], (cost + extra, letters + "K", [*lines, f"{role}:{text}"])))
                other = "assistant" if last == "u" else "user"
                options.append((other[0], (cost + 2 + extra, letters + "R", [*lines, f"{other}:{text}"])))
            for q, way in options:
                new[q] = min(new.get(q, way), way)
        ways = new
    cost, letters, lines = min(way for last, way in inserts(ways).items() if last in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(table, damage=True):
    rows = []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if lot == 0:
            rows.append((conv, None))
            continue
        text = "" if lot == 1 else "".join(c for c in text if c not in ".!?") if lot == 2 else text
        rows += [(conv, (turn, "user" if lot == 4 else role, text))] * (2 if lot == 3 else 1)
    md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    out = {}
    for conv in {c for c, _ in rows}:
        own = [r for c, r in rows if c == conv and r]
        out[conv] = plain(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, md5(r))))
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def table():
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None), (2, None, "user", "So?"), (2, 5, "assistant", "No"),
        (3, 1, "system", "Be kind."), (3, 2, "system", "Be kind."), (3, 9, "user", "Hm. "), (3, 9, "user", "Hm. "), (3, 9, "assistant", "x!"),
        (None, 1, "user", "a."), (None, 2, "tool", "b"), (None, 2, "", "c."), (4, None, "user", " \n"), (5, 3, "Übung", "ü…"),
        (6, 1, "assistant", "word " * 50_000 + "."), (6, 2, "user", ""), (7, -3, "user", "x."), (7, 4, "assistant", "x."),
    ]
    roles = ["user", "assistant", "system", "user", "assistant", "bot"]
    for conv in range(10, 60):  # a long one of each kind too
        n = 300 if conv in (20, 21, 22) else conv % 13
        for t in range(n):
            k = zlib.crc32(f"{conv}/{t}".encode())
            role = "user" if conv == 20 else roles[k % 6] if conv == 21 or conv % 3 else roles[t % 2]
            rows.append((conv, t // (1 + conv % 2), role, f"t{k % 40 if conv % 5 else t}" + (".", "", "?", "!")[k // 7 % 4]))
    return rows




@pytest.mark.parametrize("damage", [True, False])
@pytest.mark.parametrize("parts", [1, 8, 60])
def test_equals_the_plain_version(spark, given, damage, parts):
    rows = given([(*r, "x", "y") for r in table()], COLUMNS).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, dropped = damaged(rows) if damage else (rows, None)
        assert found(Repair(rows, gone=dropped).conversations()) == expected(table(), damage)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_turns_by_a_shuffle_and_small_pieces(given, monkeypatch):
    monkeypatch.setattr(structure, "SENT", -1)
    monkeypatch.setattr(structure, "PIECE", 10)
    rows = given([(*r, "x", "y") for r in table()], COLUMNS)
    assert found(Repair(rows).conversations()) == expected(table(), False)


def test_repaired_turns(given):
    rows = [r for r in Repair(given([(*r, "x", "y") for r in table()], COLUMNS)).turns().collect()]
    want, key = expected(table(), False), lambda r: (r.conv_id is None, r.conv_id or 0)
    for conv, own in groupby(sorted(rows, key=lambda r: (key(r), r.part, r.place)), key=lambda r: r.conv_id):
        own = list(own)
        assert "".join(r.edit for r in own) == want[conv][6]
        lines = [f"{r.role}:{r.text}" for r in own if r.edit != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[conv][7]


def test_long_runs():
    assert len(audit("a" * 100_000)[0].replace("I", "")) == 100_000
    for text in ("u" * 64, "a" * 37, "-" * 20 + "u", "sss", "UUUAAA" * 9, "", "x" * 33):
        rows = [(i, {"u": "user", "a": "assistant", "s": "system", "x": "bot"}.get(c.lower(), "user"), "" if c == "-" else f"{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(text)]
        assert audit(text)[0] == plain(rows)[6], text


def test_empty(given):
    none = given([], COLUMNS)
    assert Repair(none).conversations().count() == Repair(none).turns().count() == 0
    rows, dropped = damaged(none)
    assert Repair(rows, gone=dropped).conversations().count() == 0
    gone = given([(1, 1, "user", "a.", "x", "y")], COLUMNS)
    assert found(Repair(gone, gone=F.lit(True)).conversations()) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
