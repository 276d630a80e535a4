import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sensorloom.llm.prefixes import PrefixCounts, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "don't we'll 'RE  x\n\ty <|endoftext|>a", "Straße İstanbul é ﬁ 123 日本語 \U0001f600!!'s", "'r 're''s", "x" * 300]


@pytest.fixture(scope="module")
def both():
    return PrefixCounts(PATH), Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_totals_and_prefixes_are_the_librarys(both):
    counter, library = both
    rng = random.Random(3)
    made = ["".join(rng.choice("ab'sretlvmd  .!éßİÅ9\n中\U0001f600<|") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    given = ODD + made
    assert [int(c.sum()) for c in counter.totals(given)] == [count(library, t) for t in given]
    for t in made[:80]:
        n = counter.normal(t)
        assert counter.unit(n) == [count(library, n[:k]) for k in range(len(n) + 1)]


def test_cut_holds_the_limit(both):
    counter, library = both
    text = "the wonderful unbelievable gardens of extraordinarily long words " * 3
    counts = counter.totals([text])[0]
    for limit in range(0, int(counts.sum()) + 1):
        k = counter.cut(text, counts, limit)
        assert count(library, text[:k]) <= limit
        assert limit < counts.sum() or k == len(text)


@pytest.mark.parametrize(
    "text",
    [
        "word\r\n" * 12, "one\t\ttwo three\t\t" * 5, "漢字\n\n" * 8, "漢字 かな\n\n" * 5, "cafe\u0301 re\u0301sume\u0301\n" * 4, "cafe\u0301re\u0301sume\u0301" * 3,
        "a<|endoftext|>b unbelievable<|endoftext|>\nextraordinarily" * 3, "<|endoftext|>" * 4, "İstanbulİİ don't we'll" * 3, "\n\n\n", "  x  \n y",
    ],
)
def test_cut_is_the_longest_within_the_limit(both, text):
    counter, library = both
    counts = counter.totals([text])[0]
    tokens = [count(library, text[:k]) for k in range(len(text) + 1)]
    for limit in range(0, int(counts.sum()) + 1):
        k = counter.cut(text, counts, limit)
        assert k == max(i for i, n in enumerate(tokens) if n <= limit), (limit, k)


def test_odd_rows(odd, none, both):
    out = token_counts(odd, PATH, limit=40, keep=["doc_id"], table=True).collect()
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(out) == 14
    for r in out:
        t = text[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), count(both[1], t))
        assert r.over_limit == (r.n_tokens > 40) and r.prefix_tokens[-1] == r.n_tokens
    assert token_counts(none, PATH, keep=["doc_id"]).count() == 0
