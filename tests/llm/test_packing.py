import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorloom.llm.packing import Limits, pack
from sensorloom.llm.tokens import ByteLevelIds

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", "a  b", " lead", "trail ", "x<|endoftext|>y <|endoftext|> z", "\U0001f600 é", "don't  we'll\n\n\nso", "a" * 500]
ODD += ["line\r\nnext\r\n\r\n  end", "\t\ttab\t x", " " * 3000 + "x", "\n" * 500, "漢字かな交じり文 " * 40, "é́ combining", "x" * 1_000_000, "a1b22c333 " * 50_000, "I'LL 'S ''t"]


def test_ids_are_the_librarys():
    ours, library = ByteLevelIds(PATH), Tokenizer.from_file(PATH)
    for t, ids in zip(ODD, ours.encode(ODD)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def check(rows, lim):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= lim.tokens and at & (at - 1) == 0
        assert len(pieces) <= lim.segments and sum(r.loss_tokens for r in pieces) <= lim.loss
    return by_doc


@pytest.mark.parametrize("lim", [Limits(), Limits(64, 3, 64), Limits(64, 8, 20), Limits(16, 1, 1)])
def test_every_id_once_within_the_limits(odd, lim):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    library = Tokenizer.from_file(PATH)
    by_doc = check(pack(docs, PATH, limits=lim).collect(), lim)
    assert by_doc.keys() == text.keys()
    for i, pieces in by_doc.items():
        ids = np.array([*library.encode(text[i], add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_prompts_bear_no_loss(plain):
    docs = plain([(i, "one two three four five six", 3) for i in range(40)], "doc_id long, text string, lead int")
    lim = Limits(32, 32, 12)
    rows = pack(docs, PATH, prompt_tokens="lead", limits=lim).collect()
    check(rows, lim)
    assert sum(r.loss_tokens for r in rows) == 40 * (7 - 3)


def test_odd_rows(odd, none):
    rows = pack(odd, PATH).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    got = {r.doc_id: (r.n, r.d) for r in rows}
    assert got[5] == got[6] == (1, 1) and got[9][0] == 2 * got[9][1] and None in got
    assert pack(none, PATH).count() == 0


def test_many_short_documents_take_linear_time(given):
    import time

    docs = given([(0, "")]).sparkSession.range(0, 500_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    began = time.time()
    rows = pack(docs, PATH).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s"), F.max("offset").alias("o")).first()
    assert time.time() - began < 60 and rows.n == 500_000 and rows.o == 127 and rows.s < 500_000 / 128 + 8
