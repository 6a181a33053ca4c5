"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a .model file; a piece's log score is that of its rank under
Zipf's law, log(1 / ((rank + 100) * H)), since the file's own scores are merge ranks.
Spaces become U+2581 and one is put before a text; as no piece holds that mark after
another character, the best path of a text is that of its words one after another,
so a worker solves each distinct word once, thousands of words at a time. Characters
without a piece fall back to byte pieces.

Defined results: a null or empty text has no pieces; the mark itself in a text
decodes to a space; bytes that are no UTF-8 decode to U+FFFD; rows are encoded each
for itself; empty tables give no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10_000_000
LOWEST = -(1 << 60)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[i : i + n]
            i += n


@dataclass
class Vocabulary:
    pieces: list[str]
    kinds: list[int]
    scores: np.ndarray

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            found = [dict(fields(x)) for n, x in fields(f.read()) if n == 1]
        pieces = [x[1].decode() for x in found]
        kinds = [x.get(3, NORMAL) for x in found]
        ranks = np.array([-struct.unpack("<f", x[2])[0] if 2 in x else 0.0 for x in found])
        weight = 1 / (np.maximum(ranks, 0) + 100)
        usual = np.array([k in (NORMAL, USER) for k in kinds])
        # In millionths, as integers: sums are exact and ties fall alike whatever stands before a word.
        return Vocabulary(pieces, kinds, np.rint(1e6 * np.log(weight / weight[usual].sum())).astype(np.int64))


@dataclass
class Trie:
    """Double array over UTF-8 bytes: a state s goes to t = base[s] + byte + 1 if check[t] == s; id[t] is the piece that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    id: np.ndarray

    @staticmethod
    def build(words: dict[bytes, int]) -> Trie:
        size = 1 << 20
        base, check, ids = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        keys = sorted(words)
        free = dense = 300  # no place is sought below ``free`` (above the largest code, so a base stays positive); states of several children aren't sought below ``dense``
        todo = [(0, 0, len(keys), 0)]  # state, range of keys, depth
        while todo:
            s, a, b, depth = todo.pop()
            if a < b and len(keys[a]) == depth:
                ids[s] = words[keys[a]]
                a += 1
            if a >= b:
                continue
            groups: list[tuple[int, int, int]] = []
            i = a
            while i < b:
                c = keys[i][depth]
                j = i + 1
                while j < b and keys[j][depth] == c:
                    j += 1
                groups.append((c, i, j))
                i = j
            codes = np.array([c + 1 for c, _, _ in groups])
            while check[free] >= 0:
                free += 1
            at = begin = max(1, (free if len(codes) == 1 else max(free, dense)) - int(codes[0]))
            while (check[at + codes] >= 0).any():
                at += 1
                if at + 600 > size:
                    raise ValueError("vocabulary too large for the trie")
            if at - begin > 16:
                dense = max(dense, at)
            base[s] = at
            check[at + codes] = s
            todo += [(at + c + 1, i, j, depth + 1) for c, i, j in groups]
        used = int(np.flatnonzero(check >= 0).max()) + 300
        return Trie(base[:used].copy(), check[:used].copy(), ids[:used].copy())


class Encoder:
    """``cache``: how many words a worker remembers."""

    def __init__(self, path: str, cache: int = 400_000):
        self.vocabulary = v = Vocabulary.read(path)
        words = {p.encode(): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k in (NORMAL, USER) and p}
        self.by_word = not any(MARK in p.lstrip(MARK) for p, k in zip(v.pieces, v.kinds, strict=True) if k in (NORMAL, USER))
        self.trie = Trie.build(words)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        usual = [v.scores[i] for i in words.values()]
        self.unknown_score = int(min(usual)) - UNKNOWN_PENALTY
        self.lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.id.tolist(), v.scores.tolist())
        self.shown = np.array([p if k != BYTE else "" for p, k in zip(v.pieces, v.kinds, strict=True)], dtype=object)
        self.byte_of = np.full(len(v.pieces), -1, np.int16)
        for b, i in self.bytes.items():
            self.byte_of[i] = b
        self.limit, self.cache = cache, {}

    def best_path(self, data: bytes) -> list[int]:
        """Viterbi over one string; of equal scores the path with the earlier start of the last piece."""
        base, check, ids, scores = self.lists
        n = len(data)
        best, start, piece = [LOWEST] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        for i in range(n):
            if data[i] & 0xC0 == 0x80:
                continue
            b = data[i]
            char = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            state, single, here = 0, False, best[i]
            for j in range(i, n):
                t = base[state] + data[j] + 1
                if t >= len(check) or check[t] != state:
                    break
                state = t
                p = ids[t]
                if p >= 0:
                    single |= j + 1 - i == char
                    if here + scores[p] > best[j + 1]:
                        best[j + 1], start[j + 1], piece[j + 1] = here + scores[p], i, p
            if not single and here + self.unknown_score > best[i + char]:
                best[i + char], start[i + char], piece[i + char] = here + self.unknown_score, i, -1
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            elif self.bytes:
                out += [self.bytes[x] for x in reversed(data[start[n] : n])]
            else:
                out.append(self.unknown)
            n = start[n]
        return out[::-1]

    def best_paths(self, words: list[bytes]) -> list[bytes]:
        """The same for many short strings at once; ids as little-endian 32-bit bytes."""
        t, scores = self.trie, self.vocabulary.scores
        n = len(words)
        length = np.array([len(w) for w in words])
        wide = int(length.max())
        data = np.zeros((n, wide + 1), np.uint8)
        data[np.arange(wide + 1) < length[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((n, wide + 1), LOWEST, np.int64)
        best[:, 0] = 0
        start, piece = np.zeros((n, wide + 1), np.int16), np.full((n, wide + 1), -2, np.int32)
        char = np.select([data < 0x80, data < 0xC0, data < 0xE0, data < 0xF0], [1, 0, 2, 3], 4)
        for i in range(wide):
            rows = np.flatnonzero((length > i) & (char[:, i] > 0))
            here, width = best[rows, i], char[rows, i]
            single = np.zeros(n, bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, wide):
                r = rows[live]
                to = t.base[state] + data[r, j] + 1
                ok = (t.check[np.minimum(to, len(t.check) - 1)] == state) & (length[r] > j) & (to < len(t.check))
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                p = t.id[state]
                end = p >= 0
                who, q = live[end], p[end]
                r = rows[who]
                single[r[width[who] == j + 1 - i]] = True
                new = here[who] + scores[q]
                better = new > best[r, j + 1]
                r = r[better]
                best[r, j + 1], start[r, j + 1], piece[r, j + 1] = new[better], i, q[better]
            lost = ~single[rows]
            r, end, new = rows[lost], i + width[lost], here[lost] + self.unknown_score
            better = new > best[r, end]
            r, end = r[better], end[better]
            best[r, end], start[r, end], piece[r, end] = new[better], i, -1
        at, columns, begins, rows = length.copy(), [], [], np.arange(n)
        while (at > 0).any():
            columns.append(np.where(at > 0, piece[rows, at], -3))
            at = np.where(at > 0, start[rows, at], 0)
            begins.append(at)
        ids = np.stack(columns[::-1], 1).astype("<i4")
        begins = np.stack(begins[::-1], 1)
        count = (ids > -3).sum(1)
        bad = (ids == -1).any(1)
        width, out = ids.shape[1], []
        for k, c in enumerate(count.tolist()):
            out.append(self._with_bytes(words[k], ids[k, width - c :].tolist(), begins[k, width - c :].tolist()) if bad[k] else ids[k, width - c :].tobytes())
        return out

    def _with_bytes(self, word: bytes, ids: list[int], begins: list[int]) -> bytes:
        """The ids with byte pieces (or the unknown one) where a character has no piece."""
        out: list[int] = []
        for i, a, z in zip(ids, begins, [*begins[1:], len(word)], strict=True):
            if i >= 0:
                out.append(i)
            else:
                out += [self.bytes[x] for x in word[a:z]] if self.bytes else [self.unknown]
        return np.asarray(out, "<i4").tobytes()

    def split(self, text: str) -> list[str]:
        """The words, without the mark that each begins with, or whole units that begin with it where the text has other marks."""
        if not self.by_word:
            return [text.replace(" ", MARK)]
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        parts = [self.split(t) if t else [] for t in texts]
        new = list({w for p in parts for w in p if w not in self.cache})
        if len(self.cache) + len(new) > self.limit:
            self.cache = {}
            new = list({w for p in parts for w in p})
        coded = sorted(((MARK + w).encode(), w) for w in new)
        coded.sort(key=lambda x: len(x[0]))
        for a in range(0, len(coded), 20_000):
            block = coded[a : a + 20_000]
            short = [x for x in block if len(x[0]) <= 96]
            if short:
                self.cache.update(zip([w for _, w in short], self.best_paths([b for b, _ in short]), strict=True))
            for b, w in block[len(short) :]:
                self.cache[w] = np.asarray(self.best_path(b), "<i4").tobytes()
        return [b"".join(map(self.cache.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The text of a sequence of ids."""
        x = np.frombuffer(ids, "<i4")
        byte = self.byte_of[x]
        if (byte < 0).all():
            text = "".join(self.shown[x])
        else:
            text, i = "", 0
            cuts = np.flatnonzero(np.diff((byte >= 0).astype(np.int8))) + 1
            parts = []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True):
                parts.append(bytes(byte[i:j].astype(np.uint8)).decode("utf-8", "replace") if byte[i] >= 0 else "".join(self.shown[x[i:j]]))
            text = "".join(parts)
        text = text.replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def _blocks(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[tuple[int, list]]:
    first, held, size = 0, [], 0
    for i, x in enumerate(batch.column(text)):
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size > most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ids (32-bit little-endian) of every row."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for first, texts in _blocks(b, 1):
                ids = e.encode([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text string, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """The columns of ``coded`` with ``decoded``, the text that ``ids`` stand for."""
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        at = schema.names.index("ids")
        for b in batches:
            for first, ids in _blocks(b, at):
                part = b.slice(first, len(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else e.decode(x) for x in ids], pa.string())], schema.names)

    return coded.mapInArrow(run, schema)
