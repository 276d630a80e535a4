import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sensorloom.llm.graph import components
from sensorloom.llm.simhash import fingerprint, keep_first, links, near_duplicates


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {n: find(n) for n in nodes}


def test_fingerprint_and_engine_hash(spark):
    for t in ["", "One", "one  two", "A b\nC d e", "ÄÖ x y z ü", "p q r " * 50]:
        assert fingerprint(t.encode(), 3) == plain_print(t)
    assert spark.sql("select xxhash64('a b c') h").first().h == np.uint64(fingerprint(b"a b c", 3)).view(np.int64)


def test_links_lose_none(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 1, 3, 7, 15, 2**64 - 1, 2**63}
    for p in list(prints)[:40]:
        q = p
        for b in rng.sample(range(64), rng.randint(1, 5)):
            q ^= 1 << b
        prints.add(q)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for bits in (1, 2, 3, 4, 5):
        got = sorted(map(tuple, links(df, bits).collect()))
        want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits)
        assert got == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(60, 50), (50, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_match_brute_force(odd, none):
    rows = odd.collect()
    prints = sorted({plain_print(r.text) for r in rows})
    root = roots(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for r in rows:
        if r.doc_id is not None:
            k = root[plain_print(r.text)]
            first[k] = min(r.doc_id, first.get(k, r.doc_id))
    got = near_duplicates(odd).collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        p = plain_print(text[r.doc_id])
        assert r.fingerprint == f"{p:016x}" and r.component_id == first.get(root[p])
    assert near_duplicates(none).count() == 0


def test_one_of_each_group_stays(odd, none):
    kept = keep_first(odd)
    assert kept.columns == odd.columns
    found = {r.doc_id: r.component_id for r in near_duplicates(odd).collect()}
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == sorted({(c if c is not None else -1) for c in found.values()})
    assert keep_first(none).count() == 0


def test_many_copies(plain):
    docs = plain([(i, f"the same words again and again {i % 3 // 2}") for i in range(3000)])
    got = near_duplicates(docs).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 3000 and len(got) <= 2
