import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sensorloom.llm import trie
from sensorloom.llm.trie import RangeMinimum, prefix_nodes, prefix_trie, with_shared_beginnings

COLUMNS = "conv_id long, turn long, role string, text string, node string, key string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(table):
    out = defaultdict(list)
    md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    for conv, turn, role, text in table:
        if conv is not None:
            out[conv].append((turn, role or "", text or ""))
    return {c: [r[1:] for r in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, md5(r)))] for c, own in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = {n for n in below if len(n) == len(node) + 1}
        leaves = sum(not any(m[: len(n)] == n and len(m) > len(n) for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        up = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(own), len(node), up, len(own), len(kids), leaves, saved, digest))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def table():
    rows = [
        (1, None, "user", None), (2, None, None, ""), (None, 1, "user", "lost"), (3, 1, "user", "same"), (3, 1, "user", "same"),
        (-25, 0, "user", "below zero"), (-20, 0, "user", "base below"), (4, 0, "a", "bc"), (5, 0, "ab", "c"), (6, 0, "user", "w " * 70_000),
        (7, 9, "user", "b"), (7, 3, "user", "a"), (7, None, "user", "c"),
    ]
    for conv in range(100, 260):
        n = 120 if conv in (120, 121, 122) else conv % 6
        for t in range(n):
            k = zlib.crc32(f"{conv // 3 if conv % 2 else 0}/{t}".encode())
            rows.append((conv, t, ("user", "assistant")[t % 2], f"hello  there {k % 3}" if t > 1 else "good day"))
    return rows


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_equals_the_plain_version(spark, given, parts):
    rows = given([(*r, "x", "y") for r in table()], COLUMNS).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(prefix_trie(rows)) == plain(ordered(table()))
        assert found(prefix_nodes(with_shared_beginnings(rows))) == plain(rebuilt(ordered(table())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_blocks_and_a_shuffle_of_shared_prefixes(given, monkeypatch):
    monkeypatch.setattr(trie, "AT_ONCE", 4)
    monkeypatch.setattr(trie, "SENT", -1)
    rows = given([(*r, "x", "y") for r in table()], COLUMNS)
    assert found(prefix_trie(rows)) == plain(ordered(table()))


def test_range_minimum():
    rng = np.random.default_rng(5)
    values = rng.integers(-1, 6, 83)
    t = RangeMinimum(values)
    for _ in range(300):
        a, b = sorted(rng.integers(0, 83, 2))
        d = int(rng.integers(-1, 7))
        assert t.minimum(np.array([a]), np.array([b]))[0] == values[a : b + 1].min()
        r = l = int(a)
        while r + 1 <= 81 and values[r + 1] >= d:
            r += 1
        while l - 1 >= 0 and values[l] >= d:
            l -= 1
        assert t.right(np.array([a]), np.array([d]), 81)[0] == max(r, a) and t.left(np.array([a]), np.array([d]))[0] == l


def test_empty_and_turnless(given):
    assert prefix_trie(given([], COLUMNS)).count() == 0
    only = [(2, 0, "user", "a"), (3, 0, "user", "b")]  # both lose their one turn where more are replaced
    rows = given([(*r, "x", "y") for r in only], COLUMNS)
    assert found(prefix_nodes(with_shared_beginnings(rows))) == plain(rebuilt(ordered(only)))
    for c in range(40):
        one = [(c, 0, "user", "a b c")]
        if not rebuilt(ordered(one))[c]:
            got = found(prefix_nodes(with_shared_beginnings(given([(*one[0], "x", "y")], COLUMNS))))
            assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
            break
