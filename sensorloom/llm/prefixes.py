"""Exact token counts at every prefix of a text, by dynamic programming over a word-level BPE vocabulary."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sensorloom.functions.names import col
from sensorloom.llm.common import fresh, slices, texts, with_columns
from sensorloom.llm.tokens import library

#: Distinct units, and words, whose counts a Python worker remembers, and token pairs whose fit it remembers.
REMEMBERED, PAIRS = 600_000, 400_000
#: A longer unit or word is counted but not remembered.
LONG_UNIT = 64
#: Code points behind a cut in which a longer beginning is looked for where the normal form has another length.
LOOK_ON = 64
_PIECE = regex.compile(r"[^\t\n\x0b\x0c\r]+")


class PrefixCounts:
    """Counts at all prefixes for a BPE tokenizer that lowers its text, drops blanks and marks the ends of words.

    A merge sequence is the tokenizer's own exactly if each two neighbours in it are what their joined text merges to.
    So the last token of a prefix is the one that ends there and fits the last token of the prefix before it, and the count
    is that prefix's count plus one: one table row per byte, no merging of the whole. A second row per byte closes
    the word there, since the closing token differs.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        given = json.loads(self.tokenizer.to_str())
        model, steps = given["model"], given["pre_tokenizer"].get("pretokenizers", [])
        split = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        if model["type"] != "BPE" or len(steps) != 2 or len(split) != 1 or steps[1]["type"] != "ByteLevel" or steps[1]["use_regex"]:
            raise ValueError("needs a BPE of words found by one pattern, their bytes shown as characters")
        self.words = regex.compile(split[0]["pattern"]["Regex"])
        self.end = model.get("end_of_word_suffix") or ""
        if model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("plain merges only")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.vocab = model["vocab"]
        self.special = [t["content"] for t in given["added_tokens"]]
        parts = (given["normalizer"] or {}).get("normalizers", [])
        self.lowers = [p["type"] for p in parts] == ["NFC", "Replace", "Lowercase"] and parts[1]["pattern"] == {"Regex": r"\s+"}
        self.never = len(pairs)
        self.made = {a + b: (i, a, b) for (a, b), i in reversed(self.rank.items())}  # the first merge that makes it
        self.whole = {w for w in self.vocab if self._is_token(w)}
        self.inner = {w for w in self.whole if not (self.end and w.endswith(self.end))}
        self.closing = {w.removesuffix(self.end) for w in self.whole if w.endswith(self.end)}
        self.longest = max(len(w.removesuffix(self.end) if self.end else w) for w in self.whole)
        octets = sorted(b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r))
        rest = [b for b in range(256) if b not in set(octets)]
        self.shown = {b: chr(b) for b in octets} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, int] = {}
        self.words_known: dict[str, int] = {}

    # -------------------------------------------------------------- pieces
    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            k = ranks.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _is_token(self, token: str) -> bool:
        """Whether its own text merges to it."""
        if self.special and token in self.special:
            return False
        symbols = self._symbols(token)
        return len(symbols) == 1 or (token in self.made and self._merged(symbols) == [token])

    def _fit(self, a: str, b: str) -> bool:
        """Whether neighbours ``a, b`` stay apart.

        Merges are undone one by one, the latest first; at each step the parts that then met at the border must not
        have a merge of their own that would have come before the one undone. Of equal merges the left one is first.
        """
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > PAIRS:
                self.fits = {}
            x, y, before, ok = a, b, self.never, True
            rank, made = self.rank, self.made
            while True:
                if rank.get((x, y), self.never) < before:
                    ok = False
                    break
                left, right = made.get(x), made.get(y)
                if left is None and right is None:
                    break
                if right is None or (left is not None and left[0] > right[0]):
                    before, x = left[0], left[2]
                else:
                    before, y = right[0] + 1, right[1]
            self.fits[a, b] = ok
        return ok

    def word(self, word: str, full: bool = True) -> list[int]:
        """Counts at each byte prefix (from 0) of one word in its shown form, each prefix closed as a word.

        Not ``full``: closed only as a whole; the open rows are the same.
        """
        n, end, inner, closing, fits, most = len(word), self.end, self.inner, self.closing, self.fits, self.longest
        open_count, closed, last = [0] * (n + 1), [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            first = i - most if i > most else 0
            if i < n:
                for j in range(first, i):
                    token = word[j:i]
                    if token in inner:
                        pair = last[j], token
                        ok = fits.get(pair) if j else True
                        if ok or (ok is None and self._fit(*pair)):
                            last[i], open_count[i] = token, open_count[j] + 1
                            break
            if full or i == n:
                for j in range(first, i):
                    token = word[j:i]
                    if token in closing:
                        pair = last[j], token + end
                        ok = fits.get(pair) if j else True
                        if ok or (ok is None and self._fit(*pair)):
                            closed[i] = open_count[j] + 1
                            break
        return closed

    def word_total(self, word: str) -> int:
        """The last entry of its table, remembered."""
        got = self.words_known.get(word)
        if got is None:
            shown = word if word.isascii() and word.isprintable() else "".join([self.shown[b] for b in word.encode()])
            got = self.word(shown, full=False)[-1]
            if len(word) <= LONG_UNIT:
                self.words_known[word] = got
        return got

    # --------------------------------------------------------------- texts
    def unit(self, unit: str) -> list[int]:
        """Counts at each prefix (from 0) of a unit of normalised text."""
        counts, total, at = [0] * (len(unit) + 1), 0, 0
        for m in self.words.finditer(unit):
            counts[at + 1 : m.start() + 1] = [total] * (m.start() - at)
            if m[0].isascii() and m[0].isprintable():
                table = self.word(m[0])
            else:
                octets = m[0].encode()
                table = self.word("".join([self.shown[b] for b in octets]))
                table = [c for c, b in zip(table, octets + b"a") if b & 0xC0 != 0x80]
            counts[m.start() + 1 : m.end() + 1] = [total + c for c in table[1:]] if total else table[1:]
            if m[0][0] == "'" and len(m[0]) > 1 and m[0][1].isalpha():  # a contraction is two words until it is complete
                for k in range(1, len(m[0])):
                    parts = self.words.findall(m[0][:k])
                    counts[m.start() + k] = total + sum(self.word("".join(self.shown[b] for b in p.encode()))[-1] for p in parts)
            total, at = counts[m.end()], m.end()
        counts[at + 1 :] = [total] * (len(unit) - at)
        return counts

    def normal(self, text: str) -> str:
        if self.lowers and text.isascii() and text.isprintable():
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def total(self, unit: str) -> int:
        """Tokens of a unit of raw text."""
        if any(s in unit for s in self.special):
            return len(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        total = self.word_total
        return sum([total(w) for w in self.words.findall(self.normal(unit))])

    def totals(self, docs: list[str]) -> list[np.ndarray]:
        """Tokens of each space-separated unit of each text; blanks part words, so units are independent."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.words_known) > REMEMBERED:
            self.words_known = {}
        cut = [t.split(" ") for t in docs]
        new = set().union(*cut).difference(self.known)
        self.known.update((u, self.total(u)) for u in new)
        look = self.known.__getitem__
        out = [np.fromiter(map(look, units), dtype=np.int64, count=len(units)) for units in cut]
        for u in new:
            if len(u) > LONG_UNIT:
                del self.known[u]
        return out

    def cut(self, text: str, counts: np.ndarray, limit: int) -> int:
        """Code points of the longest beginning within ``limit`` tokens.

        Units before it are looked up; inside the unit that passes the limit the prefix table of its piece answers.
        """
        upto = np.cumsum(counts)
        k = int(np.searchsorted(upto, limit, side="right"))
        if k >= len(counts):
            return len(text)
        units = text.split(" ")
        start = sum(map(len, units[:k])) + k
        room = limit - (int(upto[k - 1]) if k else 0)
        return start + self._cut_unit(units[k], room)

    def _cut_unit(self, unit: str, room: int) -> int:
        """Blanks other than the space part words too, so pieces between them count on their own."""
        if any(_PIECE.fullmatch(s) is None for s in self.special):
            return self._cut_plain(unit, room)
        for m in _PIECE.finditer(unit):
            n = self.total(m[0])
            if n > room:
                return m.start() + self._cut_piece(m[0], room)
            room -= n
        return len(unit)

    def _cut_piece(self, piece: str, room: int) -> int:
        """Special strings stand between parts that count on their own."""
        at = 0
        named = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        parts = named.splititer(piece) if named else [piece]
        for part in parts:
            n = self.total(part)
            if n > room:
                return at + self._cut_plain(part, room)
            room, at = room - n, at + len(part)
            found = named.match(piece, at) if named else None
            if found:
                n = self.total(found[0])
                if n > room:
                    return at
                room, at = room - n, found.end()
        return at

    def _cut_plain(self, part: str, room: int) -> int:
        """From the prefix table; where normalising moves places, by halving with whole counts and a look onwards."""
        normal = self.normal(part)
        if len(normal) == len(part):
            k = max(i for i, c in enumerate(self.unit(normal)) if c <= room)
            if part.isascii() or self.total(part[:k]) <= room:
                return k
        low, high = 0, len(part)
        while high - low > 1:
            k = (low + high) // 2
            low, high = (k, high) if self.total(part[:k]) <= room else (low, k)
        on = range(low, min(len(part), low + LOOK_ON) + 1)
        return max((k for k in on if self.total(part[:k]) <= room), default=low)


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    *,
    text: str = "text",
    limit: int = 2048,
    keep: list[str] | None = None,
    table: bool = False,
) -> DataFrame:
    """The columns ``keep`` (all), ``n_bytes, n_tokens, over_limit, cut_chars`` and, with ``table``, ``prefix_tokens``.

    ``n_tokens`` is the count of the library for the whole text, without begin, end or other added tokens; special
    strings inside a text are what the library makes of them. ``cut_chars`` is how much of the text ``limit`` tokens
    hold, in code points. ``prefix_tokens`` has the count of every prefix of the normalised text (the form that the
    tokenizer sees, without special strings), from the empty one on.

    A null text is empty: 0 bytes, 0 tokens. A very long text is counted whole, unit by unit. Equal rows each give a row;
    an empty table gives none; other columns pass through and may have any name but those of the result.
    """
    carried = fresh(docs, "count_text")
    kept = [col(c) for c in (docs.columns if keep is None else keep)]
    base = docs.select(*kept, col(text).cast("string").alias(carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for part in slices(batches, carried):
            counter = counter or prefix_counts(tokenizer)
            given = texts(part, carried)
            per_unit = counter.totals(given)
            total = [int(c.sum()) for c in per_unit]
            cut = [len(t) if n <= limit else counter.cut(t, c, limit) for t, c, n in zip(given, per_unit, total)]
            more = {
                "n_tokens": pa.array(total, type=pa.int64()),
                "cut_chars": pa.array(cut, type=pa.int64()),
            }
            if table:
                more["prefix_tokens"] = pa.array([counter.unit(counter.normal(t)) for t in given], type=pa.list_(pa.int32()))
            names = [n for n in part.schema.names if n != carried]
            yield with_columns(part, {*part.schema.names} - {*names}, **more)

    extra = [StructField("n_tokens", LongType()), StructField("cut_chars", LongType())]
    if table:
        extra.append(StructField("prefix_tokens", ArrayType(IntegerType())))
    size = fresh(docs, "count_bytes")
    sized = base.withColumn(size, F.coalesce(F.octet_length(carried), F.lit(0)).cast("long")).select(
        *[c for c in base.columns if c != carried], size, carried
    )
    schema = StructType([*sized.schema.fields[:-1], *extra])
    counted = sized.mapInArrow(run, schema)
    return counted.select(
        *[col(f.name) for f in base.schema.fields[:-1]],
        col(size).alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        *[f.name for f in extra[1:]],
    )
