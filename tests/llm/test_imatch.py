import hashlib

import numpy as np
import pytest
import xxhash

from sensorloom.llm.imatch import EDGES, Band, Fingerprints, beside_next, document_frequencies, fingerprints, lexicon, likeness, term_hashes


def terms(text):
    return {w.strip(EDGES) for w in (text or "").lower().split()} - {""}


def mix(x, seed):
    x = (x + seed * 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain(rows, band):
    """``{(id, text): result}``, by sorting all rows and counting with dictionaries."""
    df = {}
    for _, t in rows:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    least, most = max(2, -(-len(rows) * band.rare // 1)), max(2, len(rows) * band.common // 1)
    band_terms = {w for w, n in df.items() if least <= n <= most}

    def print_of(text):
        own = sorted(xxhash.xxh3_64_intdigest(w.encode()) for w in (terms(text) & band_terms or terms(text)))
        parts = [[h for h in own if mix(h, band.seed + k) < int(s * 2**64)] for k, s in enumerate(band.keep)]
        return [xxhash.xxh3_64_intdigest(np.array(p, dtype=np.uint64).tobytes()) if p else 0 for p in parts]

    def near(a, b):
        some = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in some) / len(some) if some else 1.0

    out = []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, (r[1] or "").encode())))
    for (i, t), (_, other) in zip(order, [*order[1:], *order[:1]]):
        t, other = t or "", other or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        a, b, c = print_of(t), print_of(edited), print_of(other)
        text = "".join
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(f"{x:016x}" for x in a), text(f"{x:016x}" for x in b), near(a, b), near(a, c)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_equals_the_plain_version(odd, parts):
    docs = odd.select("doc_id", "text").repartition(parts)
    band = Band(rare=0.05, common=0.6)
    want = plain([tuple(r) for r in docs.collect()], band)
    assert found(beside_next(docs, lexicon(docs, band))) == want


def test_many_documents(given):
    rows = [(i * 7 % 501 - 100, " ".join(f"w{(i * k) % 97}" for k in range(1, 3 + i % 50)) + f" only{i}.") for i in range(501)]
    docs = given(rows).repartition(9)
    assert found(beside_next(docs, lexicon(docs))) == plain(rows, Band())


def test_frequencies(odd):
    got = {r.term % 2**64: r.n for r in document_frequencies(odd).collect()}
    want = {}
    for r in odd.collect():
        for w in terms(r.text):
            h = xxhash.xxh3_64_intdigest(w.encode())
            want[h] = want.get(h, 0) + 1
    assert got == want


def test_likeness_follows_the_edit(given):
    rng = np.random.default_rng(3)
    words = [f"term{i}" for i in range(3000)]
    texts = [list(rng.choice(words, 200)) for _ in range(400)]
    docs = given([(i, " ".join(t)) for i, t in enumerate(texts)])
    own = lexicon(docs)
    near = {}
    for share in (0.0, 0.02, 0.5, 1.0):
        got = []
        for i, t in enumerate(texts[:100]):
            cut = int(len(t) * (1 - share))
            got.append(likeness(own.of(" ".join(t)), own.of(" ".join(t[:cut] + texts[i + 1][: len(t) - cut]))))
        near[share] = np.mean(got)
    assert near[0.0] == 1 and near[0.02] > 2 * near[0.5] > 10 * near[1.0], near


def test_odd_rows(odd, none, given):
    own = lexicon(odd)
    got = fingerprints(odd, own, name="print")
    assert got.columns == [*odd.columns, "print"]
    rows = [(r.text, bytes(r.print)) for r in got.collect()]
    assert len(dict(rows)) == len(set(rows))  # equal texts, equal fingerprints
    with pytest.raises(ValueError):
        fingerprints(odd, own, name="features")
    assert beside_next(none.select("doc_id", "text"), lexicon(none)).count() == 0
    one = given([(4, "alone in here")])
    row = beside_next(one, lexicon(one)).first()
    assert row.near_next == 1.0 and row.n_chars == 13
    many_null = given([(None, f"text {i}") for i in range(50)]).repartition(7)
    assert found(beside_next(many_null, lexicon(many_null))) == plain([(None, f"text {i}") for i in range(50)], Band())
    assert len(Fingerprints(np.zeros(0, np.uint64), Band()).of("")) == 32 and not len(term_hashes(" - ... "))
