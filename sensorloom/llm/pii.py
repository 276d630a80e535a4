"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose candidate spans. Labelers (shape, checksum or range, gazetteer, words before, what the span touches)
vote on each; expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, and a
logistic model trained on the resulting soft labels judges span features. Spans of the four base kinds that pass
their fixed check always stay; the model decides on the further ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.functions.names import col
from sensorloom.llm.common import durable

# Base patterns. Each finds the same spans as the plain form beside it, without going over a run of
# characters once for each of its starts: a span may begin only where a run begins or the last span ended.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: kind and pattern; where two could start at one place, the first kind counts.
EXTRA = {
    "credential": r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key)[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?[^\s\"']{6,}+[\"']?",
    "key": r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9]|AKIA)[A-Z]{2,6}[A-Z0-9]{14,}+(?![A-Za-z0-9])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?[\[(](?i:at)[\])][\x20]?[A-Za-z0-9-]++(?:(?:\.|[\x20]?[\[(](?i:dot)[\])][\x20]?)[A-Za-z0-9-]{2,}+)++",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9.])[0-9]{1,6}(?:\.[0-9]{1,4})?\.?(?![0-9.-])",
}
KINDS = [*BASE, *EXTRA]
_MARK, _INSTEAD = "\ue000", "\ue001"  # marks span edges; a mark in a text counts as another character of equal length
_SIDE = 24  # characters seen on each side of a span

# Gazetteers and cue words.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it"
KEY_HEADS = "AKIA|ASIA|AGPA|AIDA|AROA|GHP|SK|PK"
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "masked_email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|addr|login",
    "card": "card|visa|credit|pay|karte|tarjeta|carte",
    "phone": "call|phone|tel|mobile|fax|telefon",
    "local_phone": "call|phone|tel|mobile|fax|telefon",
    "national_id": "ssn|social|security|id",
    "credential": "login|user|auth|account",
    "key": "key|token|aws|secret",
    "number": "ssn|card|phone|pin",
}
PLAIN_CUES = "version|license|licence|section|page|chapter|table|figure|by|nc|sa|nd|vol|no"


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers and the weights of the span classifier."""

    prior: float
    right: dict[str, tuple[float, float]]  # labeler: (says yes to personal, says no to other)
    weights: dict[str, float]


# ---------------------------------------------------------------- candidates
def _split(text: Column, pattern: str) -> Column:
    """A text cut at the spans of a pattern: spans at odd positions, what lies between at even ones."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)


def _pieces(parts: Column, kind: str) -> Column:
    """``(kind, pos, len, hit, tail, head)`` of each part."""
    pieces = F.transform(
        parts,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("pos"),
            F.length(x).cast("long").alias("len"),
            F.when(i % 2 == 1, x).alias("hit"),
            F.when(i % 2 == 0, F.right(x, F.lit(_SIDE))).alias("tail"),
            F.when(i % 2 == 0, F.left(x, F.lit(_SIDE))).alias("head"),
        ),
    )
    return F.when(F.size(parts) > 1, pieces)


def candidates(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``row`` and one row per candidate span: ``kind, start, end, hit, before, after``.

    Rows without a candidate keep one row with a null kind. Only lengths, the spans and a few characters around them are
    shuffled, keyed by row; ``row`` is an id of the input row within one evaluation.
    """
    base = docs.select(
        *[col(k) for k in keys],
        F.monotonically_increasing_id().alias("row"),
        F.translate(F.coalesce(col(text).cast("string"), F.lit("")), _MARK, _INSTEAD).alias("given"),
    )
    given = F.col("given")
    digits = given.rlike("[0-9]")
    gate = {
        "email": F.instr(given, "@") > 0,
        "phone": F.instr(given, "+") > 0,
        "ip": digits,
        "card": digits,
        "local_phone": digits,
        "national_id": digits,
        "number": digits,
    }
    parts = []
    for kind, pattern in {**BASE, **EXTRA}.items():
        found = _split(given, pattern)
        parts.append((F.when(gate[kind], found) if kind in gate else found).alias(f"l_{kind}"))
    none = F.array().cast(
        "array<struct<kind:string,pos:int,len:bigint,hit:string,tail:string,head:string>>"
    )
    # the parts are columns of their own, so that each pattern runs once though they are used twice
    split = base.select(*[col(k) for k in keys], "row", *parts)
    whole = split.select(
        *[col(k) for k in keys],
        "row",
        F.concat(*[F.coalesce(_pieces(F.col(f"l_{k}"), k), none) for k in KINDS]).alias("pieces"),
    )
    pieces = whole.select(*[col(k) for k in keys], "row", F.inline_outer("pieces"))
    order = Window.partitionBy("row", "kind").orderBy("pos")
    placed = pieces.select(
        *[col(k) for k in keys],
        "row",
        "kind",
        "hit",
        F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.col("len"),
        F.coalesce(F.lag("tail").over(order), F.lit("")).alias("before"),
        F.coalesce(F.lead("head").over(order), F.lit("")).alias("after"),
    )
    kept = placed.where(F.col("hit").isNotNull() | F.col("kind").isNull() | ((F.col("start") == 0) & F.col("hit").isNull()))
    return kept.select(
        *[col(k) for k in keys],
        "row",
        F.when(F.col("hit").isNotNull(), F.col("kind")).alias("kind"),
        "start",
        (F.col("start") + F.col("len")).alias("end"),
        "hit",
        "before",
        "after",
    )


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = F.translate(back, "0123456789", "0246813579")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.substring(F.when(i % 2 == 1, back).otherwise(doubled), i, F.lit(1)).cast("int"),
    )
    return total % 10 == 0


def passes(kind: Column, hit: Column) -> Column:
    """The fixed check of a base kind: octets up to 255, digit counts, Luhn."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


# ----------------------------------------------------------------- labelers
def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def labelers() -> dict[str, Column]:
    """Votes 1, -1 or 0 (no opinion) over the columns of ``candidates`` and ``valid``."""
    kind, hit = F.col("kind"), F.col("hit")
    before, after = F.lower("before"), F.col("after")
    last_word = F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]*$", 1)
    cue = F.lit(False)
    for name in KINDS:
        cue = F.when(kind == name, last_word.rlike(f"^(?:{CUES[name]})")).otherwise(cue)
    digits = F.regexp_replace(hit, "[^0-9]", "")
    telling = F.when(kind.isin("email", "masked_email", "credential", "key"), F.lower(hit)).otherwise(digits)
    distinct = F.size(F.array_distinct(F.split(telling, "")))
    gazetteer_yes = (
        F.when(kind.isin("email", "masked_email"), F.lower(hit).rlike(rf"[.\])\x20](?:{TOP_DOMAINS})$"))
        .when(kind == "key", hit.rlike(f"^(?:{KEY_HEADS})"))
        .when(kind == "credential", hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"))
        .when(kind.isin("phone", "local_phone"), ~digits.rlike("^0+$"))
        .otherwise(False)
    )
    return {
        "shape": _vote(kind.isin(*BASE, "credential", "masked_email", "national_id", "local_phone", "key") & (F.length(hit) >= 7), kind == "number"),
        "checksum": _vote(F.col("valid"), kind.isin(*BASE) & ~F.col("valid")),
        "gazetteer": _vote(gazetteer_yes, kind.isin("key") & ~hit.rlike("[0-9]")),
        "context": _vote(cue, last_word.rlike(f"^(?:{PLAIN_CUES})$")),
        "edges": _vote(
            before.rlike(r"(?:^|[\s(<\"':,;])$") & after.rlike(r"^(?:$|[\s)>\"',.;:!?])") & (F.length(hit) >= 7),
            before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]"),
        ),
        "variety": _vote(distinct >= 6, distinct <= 2),
    }


#: Classes of each feature that the span classifier has beside the votes.
LENGTHS, DIGITS, WORDS = 5, 4, 16


def own_features() -> dict[str, Column]:
    """What the labelers don't see: how long a span is, its share of digits, and hashes of the words beside it."""
    n, hit = F.length("hit"), F.col("hit")
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    word = lambda text, pattern: F.lower(F.regexp_extract(text, pattern, 1))
    before, after = word(F.col("before"), r"([\p{L}]+)[^\p{L}]*$"), word(F.col("after"), r"^[^\p{L}]*([\p{L}]+)")
    return {
        "f_length": F.when(n < 8, 0).when(n < 12, 1).when(n < 16, 2).when(n < 32, 3).otherwise(LENGTHS - 1),
        "f_digits": F.least(F.floor(DIGITS * digits / n), F.lit(DIGITS - 1)).cast("int"),
        "f_before": F.when(before == "", -1).otherwise(F.pmod(F.xxhash64(before), F.lit(WORDS)).cast("int")),
        "f_after": F.when(after == "", -1).otherwise(F.pmod(F.xxhash64(after), F.lit(WORDS)).cast("int")),
    }


def _features(votes: list[str]) -> list[str]:
    sizes = {"f_length": range(LENGTHS), "f_digits": range(DIGITS), "f_before": range(-1, WORDS), "f_after": range(-1, WORDS)}
    own = [f"{f}:{x}" for f, xs in sizes.items() for x in xs]
    return [*[f"kind:{k}" for k in KINDS], *[f"{v}:{s}" for v in votes for s in ("yes", "no")], *own]


def fit(voted: DataFrame, *, rounds: int = 50) -> SpanModel:
    """Expectation-maximisation over the votes, then the span classifier on its soft labels.

    What comes to the driver is one row per kind, pattern of votes and classes of own features: their number is bounded by
    the labelers and the classes, whatever the number of spans.
    """
    names, own = list(labelers()), list(own_features())
    rows = voted.where("kind is not null").groupBy("kind", *names, *own).agg(F.count("*").alias("n")).collect()
    cells = sorted(((r["kind"], tuple(r[v] for v in names), tuple(r[f] for f in own)), r["n"]) for r in rows)
    counts: dict = {}
    for (kind, votes, _), n in cells:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    data = sorted(counts.items())
    total = sum(n for _, n in data)
    prior, right = 0.5, {v: (0.8, 0.8) for v in names}
    soft: dict = {}
    for _ in range(rounds if total else 0):
        for (kind, votes), n in data:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, x in zip(names, votes):
                if x:
                    a, b = right[v]
                    yes += math.log(a if x > 0 else 1 - a)
                    no += math.log(b if x < 0 else 1 - b)
            soft[kind, votes] = 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))
        # a labeler counts as right about 8 times out of 10 before the data speak
        for i, v in enumerate(names):
            said = [(soft[k], k[1][i], n) for k, n in data if k[1][i]]
            a = (8 + sum(p * n for p, x, n in said if x > 0)) / (10 + sum(p * n for p, _, n in said))
            b = (8 + sum((1 - p) * n for p, x, n in said if x < 0)) / (10 + sum((1 - p) * n for p, _, n in said))
            right[v] = (min(a, 0.99), min(b, 0.99))
        prior = min(0.95, max(0.05, sum(soft[k] * n for k, n in data) / total))
    features = ["bias", *_features(names)]
    place = {f: i for i, f in enumerate(features)}
    hits = np.zeros((len(cells), len(features)))
    for i, ((kind, votes, mine), _) in enumerate(cells):
        on = ["bias", f"kind:{kind}", *[f"{v}:{'yes' if x > 0 else 'no'}" for v, x in zip(names, votes) if x]]
        hits[i, [place[f] for f in [*on, *[f"{f}:{x}" for f, x in zip(own, mine)]]]] = 1
    weight = np.zeros(len(features))
    share = np.array([n for _, n in cells]) / max(total, 1)
    goal = np.array([soft[kind, votes] for (kind, votes, _), _ in cells])
    for _ in range(400 if total else 0):  # gradient steps on the weighted cells, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(hits @ weight, -700, 700)))
        weight -= 2.0 * (1e-3 * weight + ((p - goal) * share) @ hits)
    return SpanModel(prior, right, dict(zip(features, weight.tolist())))


def _probability(model: SpanModel) -> Column:
    z = F.lit(model.weights["bias"])
    for k in KINDS:
        z = z + F.when(F.col("kind") == k, model.weights[f"kind:{k}"]).otherwise(0.0)
    for v in labelers():
        yes, no = model.weights[f"{v}:yes"], model.weights[f"{v}:no"]
        z = z + F.when(F.col(v) == 1, yes).when(F.col(v) == -1, no).otherwise(0.0)
    for f in own_features():
        known = {int(k.split(":")[1]): w for k, w in model.weights.items() if k.startswith(f"{f}:")}
        z = z + F.element_at(F.array(*[F.lit(known[x]) for x in sorted(known)]), F.col(f) - min(known) + 1)
    return 1 / (1 + F.exp(-z))


# ---------------------------------------------------------------- operators
def find_spans(docs: DataFrame, *, keys: list[str], text: str = "text", least: float = 0.5) -> DataFrame:
    """``keys``, ``row`` and ``found``: the spans of each input row, by kind as listed and then start.

    ``found`` is an array of ``(kind_no, start, end, kind, base)`` in code points, the end exclusive. Base spans that
    pass their check are always in it; others if the classifier gives ``least`` or more, unless they overlap a base
    span or lie in an earlier further one. Base candidates that fail their check are dropped and only teach the model.

    A null text is empty and has no span; equal rows each get their own; a null key stays null; no row gives no row.
    Keys may have any names except those of the working columns, so callers pass renamed ones.
    """
    spans = candidates(docs, keys, text).withColumn("valid", F.coalesce(passes(F.col("kind"), F.col("hit")), F.lit(False)))
    voted = spans.select("*", *[c.alias(v) for v, c in labelers().items()], *[c.alias(f) for f, c in own_features().items()])
    # small rows without texts, read by the model and by the result: the patterns go over each text once
    voted = durable(voted.select(*[col(k) for k in keys], "row", "kind", "start", "end", "valid", *labelers(), *own_features()))
    model = fit(voted)
    number = F.lit(None).cast("int")
    for i, k in enumerate(KINDS):
        number = F.when(F.col("kind") == k, i).otherwise(number)
    keep = F.col("valid") | (~F.col("kind").isin(*BASE) & (_probability(model) >= least))
    one = F.when(
        keep,
        F.struct(number.alias("kind_no"), F.col("start"), F.col("end"), F.col("kind"), F.col("valid").alias("base")),
    )
    per_row = voted.groupBy("row").agg(
        *[F.first(col(k)).alias(k) for k in keys], F.array_sort(F.collect_list(one)).alias("all")
    )
    base = F.filter("all", lambda s: s["base"])
    extra = F.filter(
        "all",
        lambda s: ~s["base"]
        & ~F.exists(
            "all",
            lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]) & (b["base"] | (b["kind_no"] < s["kind_no"])),
        ),
    )
    return per_row.select(*[col(k) for k in keys], "row", F.concat(base, extra).alias("found"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: str | None = None) -> DataFrame:
    """All columns; in the text each span is replaced by its kind in brackets. ``size`` may name a column for its length.

    Spans meet their text by id and a hash of the text; equal rows share them. A null text stays null.
    """
    inner = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    key, body = place[doc_id], place[text]
    marked = inner.withColumn("text_hash", F.xxhash64(F.col(body).cast("string"), F.length(F.col(body).cast("string"))))
    slim = marked.select(F.col(key).alias("k"), "text_hash", F.col(body).alias("body"))
    found = find_spans(slim, keys=["k", "text_hash"], text="body").where(F.size("found") > 0)
    found = found.groupBy("k", "text_hash").agg(F.first("found").alias("found")).withColumnRenamed("text_hash", "h")
    joined = marked.join(found, marked[key].eqNullSafe(found.k) & (marked.text_hash == found.h), "left")
    by_start = F.array_sort(F.transform("found", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.col(body).substr((acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        inside = s["start"] < acc["at"]  # overlaps the span before: one mark for both
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], piece, F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.col(body).substr((acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    clean = F.when(F.col("found").isNull(), F.col(body)).otherwise(F.aggregate(by_start, start, step, finish))
    out = joined.withColumn("clean", clean)
    value = {body: F.col("clean")}
    if size:
        value[place[size]] = F.when(F.col("found").isNull(), F.col(place[size])).otherwise(F.length("clean"))
    return out.select(
        *[value.get(f"c{i}", F.col(f"c{i}")).cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(docs.columns)]
    )
