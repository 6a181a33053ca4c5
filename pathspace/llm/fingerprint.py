"""Fingerprints by randomised edit embedding.

Every text takes the same random walk: at step t of the walk it shows its current
character and moves on or stays by a random bit that depends on t and the
character alone. Texts at a small edit distance fall into step again after each edit,
so the edit distance becomes a Hamming distance of the walks. A fingerprint holds
one bit of the character shown at sampled steps, ``BITS`` for each octave
[2**k, 2**(k+1)) of steps, as 16 hex digits an octave; so it grows with the
logarithm of a text's length, and short and long texts are both resolved. Likeness
weighs each octave by its number of steps.

``near_pairs`` joins fingerprints by bands of sampled bits and verifies candidates.

Defined results: a null or empty text has the fingerprint of one empty octave; equal
texts have equal fingerprints; rows with equal ids are ordered by text; the rows
after the last one begin again at the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

BITS = 64
CLASSES = 64
PERIOD = 1 << 16


@lru_cache(maxsize=2)
def walk(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """steps[c, t]: how many steps a character of class c is shown from step t on (t modulo the period); hash bits of the classes."""
    rng = np.random.default_rng(seed)
    moves = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    steps = np.zeros((CLASSES, PERIOD), np.uint8)
    wait = np.zeros(CLASSES, np.int64)
    for t in range(2 * PERIOD - 1, -1, -1):  # twice round, so that waits across the end are right
        wait = np.where(moves[:, t % PERIOD] == 1, 1, np.minimum(wait + 1, 255))
        steps[:, t % PERIOD] = wait
    return steps, rng.integers(0, 2, CLASSES + 1, dtype=np.uint8)


@lru_cache(maxsize=64)
def sampled(octave: int, seed: int) -> np.ndarray:
    """The sampled steps of an octave, in order."""
    rng = np.random.default_rng(seed * 1000 + octave)
    return np.sort(rng.integers(1 << octave, 2 << octave, BITS))


def classes_of(text: str) -> np.ndarray:
    """A class from 0 to 63 for each code point."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return (tv.mix(code + np.uint64(0x1234567)) >> np.uint64(58)).astype(np.int64)


def fingerprints(texts: list[str], seed: int = 20) -> list[str]:
    """All texts walk side by side, one character at a time; those that have ended drop out."""
    steps, _ = walk(seed)
    flat = steps.ravel()
    kinds = [classes_of(t) for t in texts]
    length = np.array([len(k) for k in kinds], np.int64)
    order = np.argsort(-length, kind="stable")
    size = length[order]
    start = np.concatenate([[0], np.cumsum(size)])
    chars = np.concatenate([kinds[i] for i in order]) * PERIOD if len(texts) else np.zeros(0, np.int64)
    shown = np.empty(len(chars), np.int64)  # the step at which each character is shown first
    t = np.zeros(len(texts), np.int64)
    live = len(texts)
    first = start[:-1].copy()
    alone = 0
    for i in range(int(size[0]) if len(size) else 0):
        while live and size[live - 1] <= i:
            live -= 1
        if live <= 6:
            alone = i
            break
        at = first[:live] + i
        shown[at] = t[:live]
        t[:live] += flat[chars[at] + (t[:live] & (PERIOD - 1))]
    else:
        live = 0
    table, mask = memoryview(flat), PERIOD - 1
    for d in range(live):  # the few longest texts, each by itself
        now, out = int(t[d]), []
        put = out.append
        for c in chars[start[d] + alone : start[d + 1]].tolist():
            put(now)
            now += table[c + (now & mask)]
        shown[start[d] + alone : start[d + 1]] = out
        t[d] = now
    bit_of = walk(seed)[1]
    result = [""] * len(texts)
    for d, i in enumerate(order):
        a, b = start[d], start[d + 1]
        octaves = max(1, int(max(t[d], 1)).bit_length())
        steps_at = np.concatenate([sampled(k, seed) for k in range(octaves)])
        where = np.searchsorted(shown[a:b], steps_at, "right") - 1
        # After the walk's end a text shows nothing, which has a bit of its own.
        bits = np.where((where >= 0) & (steps_at < t[d]), bit_of[chars[a:b][np.maximum(where, 0)] // PERIOD] if b > a else 0, bit_of[CLASSES])
        bits = bits ^ _flips(octaves, seed)
        result[i] = np.packbits(bits.astype(np.uint8)).tobytes().hex()
    return result


@lru_cache(maxsize=64)
def _flips(octaves: int, seed: int) -> np.ndarray:
    """A random bit for each sample, so that bits are balanced whatever the characters."""
    return np.random.default_rng(seed + 7).integers(0, 2, 64 * BITS, dtype=np.uint8)[: octaves * BITS]


def likeness(a: str, b: str) -> float:
    """1 for equal walks, about 0 for unrelated ones: twice the weighted share of equal bits, less 1, not below 0."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8).reshape(-1, BITS // 8) for s in (a, b))
    octaves = max(len(x), len(y))
    equal = np.full(octaves, 0.5)
    k = min(len(x), len(y))
    equal[:k] = 1 - np.unpackbits(x[:k] ^ y[:k], axis=1).mean(1)
    weight = 2.0 ** np.arange(octaves)
    return float(max(0.0, 2 * (weight * equal).sum() / weight.sum() - 1))


def with_next(docs: DataFrame, rows_a_part: int = 2_000) -> DataFrame:
    """part, place, doc_id, text: rows in the order of doc_id, cut into parts; each part ends with a copy (copy = true) of the row after its last.

    Bounds of the parts are approximate quantiles of the ids; so one shuffle deals out the texts, and no window spans the table.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n = base.count()
    parts = max(1, min(20_000, n // rows_a_part))
    bounds = sorted({int(x) for x in base.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []}) if parts > 1 else []
    # Nulls come first, in part 0; the number of bounds below an id is its part.
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_below(bounds)) if bounds else F.lit(0)
    placed = base.withColumn("part", part.cast("int"))
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least"), F.count("*").alias("n")).orderBy("part").collect()
    # The first id of each part is copied into the part before it (of the first, into the last); at most as many as there are parts.
    before = {r["part"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}
    rows = [(r["part"], r["least"]["doc_id"], before[r["part"]]) for r in firsts]
    edge = spark.createDataFrame(rows, "part int, first_id bigint, to_part int")
    met = placed.join(F.broadcast(edge), "part", "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("to_part").alias("part"), F.lit(True).alias("copy"))
    out = met.withColumn("x", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own)))).select("x.part", "x.copy", "doc_id", "text")
    return out.repartition(max(1, min(parts, 20_000)), "part").sortWithinPartitions("part", "copy", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))


def _longs(numbers: list[int]) -> Column:
    """A constant array, folded once."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _below(bounds: list[int], step: int = 128) -> Column:
    """How many of the sorted bounds are at most doc_id: every 128th bound first, then those of one stretch."""
    most = lambda part: F.size(F.filter(part, lambda x: x <= F.col("doc_id")))
    at = F.greatest(most(_longs(bounds[::step])) - 1, F.lit(0)) * step
    return at + most(F.slice(_longs(bounds), at + 1, F.lit(step)))


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_embedding(docs: DataFrame, seed: int = 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    base = with_next(docs)

    def give(rows: list[tuple[int | None, str]], follower: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        after = [*texts[1:], follower]
        changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
        prints = fingerprints(texts + changed + [follower], seed)
        n = len(rows)
        own, other, last = prints[:n], prints[n : 2 * n], prints[-1]
        following = [*own[1:], last]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array(own, pa.string()),
                pa.array(other, pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows wait until their block is full and the row after it is known; a part's copies only serve as that row."""
        held: list[tuple[int | None, str]] = []
        part, size, closed = None, 0, False
        for b in batches:
            parts, copies, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for p, copy, doc_id, text in zip(parts, copies, ids, b.column(3), strict=True):
                text = text.as_py() or ""
                if p != part:
                    part, closed = p, False
                if copy:
                    if not closed and held:
                        yield give(held, text)
                    held, size, closed = [], 0, True
                    continue
                if size > 6_000_000:
                    yield give(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)

    return base.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_pairs(prints: DataFrame, least: float = 0.8, bands: int = 16, band_bits: int = 16, seed: int = 20, tile: int = 500) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints that agree on a band of sampled bits of their last full octaves and, verified, are at least so alike.

    prints: doc_id, fingerprint. Equal fingerprints count as one, under their least id. Each band is compared within its own bucket:
    all its members with one another, ``tile`` by ``tile`` in a task.
    """
    one = prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    rng = np.random.default_rng(seed + 11)
    picks = [sorted(rng.choice(2 * BITS, band_bits, replace=False).tolist()) for _ in range(bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, f in zip(ids, marks, strict=True):
                bits = np.unpackbits(np.frombuffer(bytes.fromhex(f), np.uint8)).reshape(-1, BITS)
                octaves = len(bits)
                for top in {octaves, octaves + 1}:  # a partner may reach one octave less or more
                    two = np.zeros((2, BITS), np.uint8)
                    for row, k in enumerate((top - 3, top - 2)):
                        if 0 <= k < octaves:
                            two[row] = bits[k]
                    flat = two.ravel()
                    out += [(f"{top}:{n}:{flat[p].tobytes().hex()}", i, f) for n, p in enumerate(picks)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["band", "doc_id", "fingerprint"])

    banded = one.select("doc_id", "fingerprint").mapInArrow(run, "band string, doc_id bigint, fingerprint string")
    # All members of a bucket meet, in square tiles of bounded size.
    sized = banded.join(banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "band").withColumn("cuts", F.ceil(F.col("members") / tile).cast("int"))
    cell = sized.withColumn("i", F.pmod(F.xxhash64("fingerprint"), F.col("cuts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    cell = cell.select("band", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "doc_id", "fingerprint", side.alias("side"))

    def verify(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(x).to_pylist() for x in ("doc_id", "fingerprint", "side")), strict=True))
        met = ((a, b, likeness(f, g)) for n, (a, f, s) in enumerate(rows) for b, g, t in rows[n + 1 :] if s != t or s == 2)
        near = [x for x in met if x[2] >= least]
        return pa.table({"a": pa.array([x[0] for x in near], pa.int64()), "b": pa.array([x[1] for x in near], pa.int64()), "likeness": pa.array([x[2] for x in near], pa.float64())})

    return cell.filter("doc_id is not null").groupBy("band", "p", "q").applyInArrow(verify, "a bigint, b bigint, likeness double").distinct()
