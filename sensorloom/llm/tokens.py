"""Exact ids of public tokenizers.

Whole texts go through an encoder with the library tokenizer's own ranks where that is the same thing; nothing is kept
between texts, so a worker holds one text's ids at a time. Texts that hold a special string go to the library itself.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Fixed value: how the library's byte-level step cuts a text into pieces.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _ranked(tokenizer):
    """A ``tiktoken`` encoder with the library tokenizer's own vocabulary, where its ids are its merge order; else None.

    Byte-level merging by lowest id and by merge order are then the same thing, in a third of the time.
    """
    import tiktoken

    given = json.loads(tokenizer.to_str())
    model, before = given["model"], given["pre_tokenizer"]
    plain = before == {**before, "type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or not plain or given["normalizer"] or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    merges = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
    joined = [model["vocab"].get(m.replace(" ", "")) for m in merges]
    if joined != list(range(256, 256 + len(merges))):
        return None
    octets = sorted(b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r))  # bytes shown as themselves
    rest = [b for b in range(256) if b not in set(octets)]
    shown = {chr(b): b for b in octets} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in given["added_tokens"]}
    ranks = {bytes(shown[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})


class ByteLevelIds:
    """Ids of texts by a byte-level tokenizer whose pieces take the one space in front of them."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.ranked = _ranked(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def one(self, text: str) -> np.ndarray:
        if self.ranked is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text."""
        return [self.one(t) for t in texts]


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevelIds:
    return ByteLevelIds(path)
