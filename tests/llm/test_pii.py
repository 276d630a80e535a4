import hashlib
import random
import re

from pyspark.sql import functions as F

from sensorloom.llm.op09 import op9_personal_data
from sensorloom.llm.pii import find_spans, redact, spelled

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def counted(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    "a@b.cd_x@y.z and a@b@c.de e.f+g%h@i-j.k.l. .@-.-",
    "1.2.3.4.5.6.7.8 001.02.255.0 256.1.1.1 1.2.3 4.5.6.7.",
    "4111-1111 1111 1111 4111111111111112 4111  1111 41111111-11111111 5",
    "+1 (212) 555-0142 +49.30.12345678 +1-2 ++12345678901 +123456789012345678",
    "\U0001f600é x@y.zz  1.1.1.1  +12345678901",
    "",
]


def base_of(found):
    return F.filter("found", lambda s: s["base"])


def test_base_spans_match_plain_search(given):
    rng = random.Random(8)
    made = ["".join(rng.choice("a1.@+-( )_9%") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts = HARD + made
    got = find_spans(given(list(enumerate(texts))), keys=["doc_id"]).select("doc_id", spelled(base_of("found")).alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.s == ",".join(counted(texts[r.doc_id])), texts[r.doc_id]


def test_very_long_runs(given):
    texts = ["1 " * 100_000, "a" * 200_000, "9" * 200_000, "+1" + "(" * 100_000, "a.b@" * 20_000, "x@y.z " * 3_000]
    got = {r.doc_id: r.s for r in find_spans(given(list(enumerate(texts))), keys=["doc_id"]).select("doc_id", spelled(base_of("found")).alias("s")).collect()}
    assert [len(got[i]) > 0 for i in range(6)] == [False, False, False, False, True, True]
    assert all(got[i] == ",".join(counted(texts[i])) for i in (3, 4, 5))


def test_further_spans_and_redaction(odd, none):
    found = find_spans(odd, keys=["doc_id"]).collect()
    assert len(found) == 14
    out = redact(odd, size="n_chars")
    assert out.columns == odd.columns
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 14
    assert got[None].text == "mail [EMAIL] or call [PHONE] now" and got[None].n_chars == len(got[None].text)
    assert "[IP]" in got[11].text and "[CARD]" in got[11].text and "300.1.1.1" in got[11].text
    text = {r.doc_id: r.text for r in odd.collect()}
    assert all(got[i].text == text[i] for i in (1, 3, 5, 6, 7, 8, 9, 13))
    assert find_spans(none, keys=["doc_id"]).count() == 0 and redact(none).count() == 0


def test_long_secrets_vanish_whole(given):
    rng = random.Random(5)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789-_."
    token = "eyJhbGciOi" + "".join(rng.choice(letters) for _ in range(490))
    key = "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(96))
    docs = given([(1, f"before token={token} after"), (2, f"aws key {key} after"), (3, f'before password: "{token}" after'), (4, "AKIA" + "A" * 400_000 + "b")])
    got = {r.doc_id: r.text for r in redact(docs).collect()}
    assert got[1] == "before [CREDENTIAL] after" and got[2] == "aws key [KEY] after" and got[3] == "before [CREDENTIAL] after"
    assert len(got[4]) == 400_005


def test_masked_addresses_vanish_whole(given):
    long = "a" * 70
    docs = given([(1, "write jo [at] a.bb.cc.dd.ee.ff.gg now"), (2, f"mail {long}(AT)site[dot]org today"), (3, "contact jo [AT] " + ".".join(["part"] * 40) + ".de"), (4, "x [at] " * 50_000)])
    got = {r.doc_id: r.text for r in redact(docs).collect()}
    assert got[1] == "write [MASKED_EMAIL] now" and got[2] == "mail [MASKED_EMAIL] today" and got[3] == "contact [MASKED_EMAIL]"
    assert got[4] == "x [at] " * 50_000


def test_query_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op9_personal_data(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = counted(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
        assert r.spans.startswith(",".join(spans))
