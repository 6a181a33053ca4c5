"""Vectorised text primitives on Arrow string buffers.

A column of texts is viewed as one UTF-8 byte array with row offsets, cut into
slices of a few megabytes, so words, lines and shingles of thousands of texts
are found and hashed by a fixed number of numpy passes. Hashes are 64 bits.
A null text counts as empty everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19


def _give_back() -> None:
    """Lets glibc return freed arrays of a megabyte or more to the system at once: a worker then holds what its slice needs, not what all before it left in pieces. Elsewhere nothing happens."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which stops its adaptive growth
    except (OSError, AttributeError):
        pass


_give_back()
_U = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; grown on demand."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for b in (_BASE, _BASE_INV):
            p = np.empty(size, _U)
            p[0] = 1
            done = 1
            while done < size:  # doubling: p[k + i] = p[k] * p[i]
                m = min(done, size - done)
                p[done : done + m] = p[:m] * _U(pow(b, done, 1 << 64))
                done += m
            out.append(p)
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Slice:
    """Rows [first, first + n) of a text column: bytes and offsets from 0."""

    def __init__(self, first: int, data: np.ndarray, off: np.ndarray):
        self.first, self.data, self.off, self.n = first, data, off, len(off) - 1

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column as slices of whole texts of about ``max_bytes`` (one text at least)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield Slice(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at row boundaries."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cut - 1] = inside[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class SpanHash:
    """Position-free 64-bit hashes of byte spans of one array."""

    def __init__(self, data: np.ndarray):
        p, self.inv = _pow_tables(len(data) + 1)
        self.total = np.empty(len(data) + 1, _U)
        self.total[0] = 0
        np.cumsum((data.astype(_U) + _U(1)) * p[: len(data)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.inv[starts]
        return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93) + _U(salt))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A position-free 64-bit hash of each byte span."""
    return SpanHash(data)(starts, ends) if len(starts) else np.zeros(0, _U)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice: spans, hashes, row of each."""

    def __init__(self, s: Slice, lower: bool = False):
        self.slice = s
        data = LOWER[s.data] if lower else s.data
        self.inside = ~IS_SPACE[data]
        self.starts, self.ends = spans(self.inside, s.off)
        self.hash = span_hash(data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, s.off)  # word index at which each row begins
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(s.n), self.count)


_MULT = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def _odd(k: int) -> np.uint64:
    """The odd multiplier of a shingle's k-th word, distinct for each place."""
    return _U((_MULT[k % 5] + 2 * k * 0x9E3779B97F4A7C15) % (1 << 64) | 1)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of ``size`` words within a row; the window at word i comes first among those from i on."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.zeros(n - size + 1, _U)
    for k in range(size):
        h += w.hash[k : n - size + 1 + k] * _odd(k)
    ok = w.row[: n - size + 1] == w.row[size - 1 :]
    return mix(h)[ok], w.row[: n - size + 1][ok]


def shingle_sets(s: Slice, size: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes; a row of fewer words has its whole sequence as one, a row without words none."""
    w = Words(s, lower=True)
    h, row = windows(w, size)
    at = np.searchsorted(row, np.arange(s.n + 1))
    for i in range(s.n):
        if w.count[i] >= size:
            x = np.sort(h[at[i] : at[i + 1]])
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            yield x[keep]
        elif w.count[i]:
            a = w.first[i]
            x = _U(int(w.count[i]) * 0x2545F4914F6CDD1D % (1 << 64))
            for k in range(w.count[i]):
                x = x + w.hash[a + k : a + k + 1] * _odd(k)
            yield mix(np.asarray(x, _U))
        else:
            yield np.zeros(0, _U)


def repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key is met twice or more in its row, and whether it is not the first such entry."""
    n = len(keys)
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        k = mix(keys + rows.astype(_U) * _U(0xA0761D6478BD642F))
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        later[order[1:]] = same
        again[order[1:]] = same
        again[order[:-1]] |= same
    return again, later


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return h.view(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


class HashTable:
    """64-bit keys to positions in an array, by open addressing; looks up whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        size = 1 << max(4, int(2 * max(1, self.n) - 1).bit_length())
        self.mask = _U(size - 1)
        self.keys = np.zeros(size, _U)
        self.at = np.full(size, -1, np.int32)
        left = np.arange(self.n, dtype=np.int32)
        slot = (mix(keys) & self.mask).astype(np.int64)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # the last one written wins the slot
            self.keys[slot[free]] = keys[left[free]]
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & int(self.mask)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it isn't there."""
        slot = (mix(keys) & self.mask).astype(np.int64)
        out = self.at[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            out[todo] = self.at[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out


class Counts:
    """Counts by 64-bit key of what a task has seen; merged in memory, given out when large."""

    def __init__(self, limit: int = 1_500_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.limit, self.held = limit, 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self._hold(keys[first], np.diff(np.append(first, len(keys))))

    def _hold(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held > self.limit:
            self._merge()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[first], np.add.reduceat(n, first))]
            self.held = len(first)

    def full(self) -> bool:
        return self.held > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out = self.parts[0] if self.parts else (np.zeros(0, _U), np.zeros(0, np.int64))
        self.parts, self.held = [], 0
        return out
