"""Byte-level BPE over pre-tokens, equal to the tokenizers library on whole texts.

A text is cut at single spaces where no pre-token of the library can cross, so
the same word is tokenised once per worker and then looked up. Pieces of a word
not met before come from the same vocabulary file; words that hold a special
string go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two white-space characters, or one after white space at the end: only there a cut before the space could change the pre-tokens.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def words(text: str) -> list[str]:
    """Parts of ``text``; joined by single spaces they give it back, and the space belongs to the part after it."""
    return _SAFE_CUT.split(text) if _UNSAFE.search(text) else text.split(" ")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Word (with the space before it) -> its ids as little-endian 32-bit bytes."""

    def __init__(self, encoder: ByteLevel, limit: int):
        super().__init__()
        self.encoder, self.limit = encoder, limit

    def __missing__(self, word: str) -> bytes:
        out = self.encoder.ids(" " + word)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = out
        return out


class ByteLevel:
    """One vocabulary file of the tokenizers library with byte-level pre-tokens."""

    def __init__(self, path: str, cache: int = 200_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies without prefix space and normaliser have these pre-tokens")
        self.library = Tokenizer.from_file(path)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.specials}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache = _Pieces(self, cache)

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def ids(self, text: str) -> bytes:
        if self.has_special(text):
            out = self.library.encode(text, add_special_tokens=False).ids
        else:
            out = self.fast.encode_ordinary(text)
        return np.asarray(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit bytes."""
        if not text:
            return b""
        if any(" " in s for s in self.specials) and self.has_special(text):
            return self.ids(text)
        first, *rest = words(text)
        return self.ids(first) + b"".join(map(self.cache.__getitem__, rest))


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    """One per worker process and file."""
    return ByteLevel(path)
