"""Exact Jaccard self-join of documents on word shingles, by prefixes of token combinations.

Documents with equal shingle sets form a class; classes are joined. A sketch of
2**22 counters over all texts puts shingles into classes of frequency. In the
global order (frequency class, hash) a class's prefix is extended until, whichever
tau = n - ceil(t * n) of its shingles a partner lacks, one rare shingle, or k shingles
of the same bucket of the k-th frequency class, are left in common. Rare
shingles are indexed alone, those of the k-th class by all k-combinations within
a bucket. Two linked classes therefore share an index key (proof at ``keys_of``).

Keys are shuffled once to find those that several classes share; a bitmap of bounded size
of these spares nearly all other entries the second shuffle. Verification goes by
falling certainty, on whole texts, one for each class. First each class is compared with
the least class that it shares a key with; links make components. Then only keys
that hold several components matter, and of them only pairs across components whose
parity bitmaps allow the link: each set has one bit for each of its shingles, modulo a power of two of at
least its size, so two bitmaps differ in no more places than the sets do (a bound, not
an estimate). Keys of few members give pairs as rows; those of many give rectangles of bounded size, the
members outside the key's largest component against all, so a member is sent once unless
the outside itself is large. No pair that could link two components is left out.

Defined results: a document without words or text has an empty set, links with nothing
and is its own component; one with fewer words than a shingle has its whole sequence
as its only shingle; rows with equal ids are each returned; a null id takes part,
and gets the least id of its component, or null where no member has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .store import stored

_U = np.uint64
SKETCH_BITS = 22
_BLOCK = 8192
NEED_BITS = 23
KEY_BITS = 26


def class_id(shingles: np.ndarray) -> int:
    """64-bit id of a shingle set."""
    total = int(tv.mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)) + len(shingles) * 0x9E3779B97F4A7C15
    return int(tv.mix(np.array([total % (1 << 64)], _U)).view(np.int64)[0])


def parity(x: np.ndarray) -> bytes:
    """One bit for each place modulo the least power of two that isn't less than the set: whether an odd number of shingles falls there."""
    size = max(64, 1 << (len(x) - 1).bit_length())
    return np.packbits(np.bincount((x >> _U(20)).astype(np.int64) & (size - 1), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(bits: int, size: int, to: int) -> int:
    """A bitmap of ``size`` bits as that of ``to`` bits."""
    while size > to:
        size //= 2
        bits = (bits >> size) ^ (bits & ((1 << size) - 1))
    return bits


def may_link(n: int, one: bytes, m: int, two: bytes, top: int, whole: int) -> bool:
    """Whether sets of n and m shingles with these bitmaps can link."""
    to = min(len(one), len(two)) * 8
    x, y = (_folded(int.from_bytes(b, "little"), len(b) * 8, to) for b in (one, two))
    both = (n + m - (x ^ y).bit_count()) // 2
    return whole * both >= top * (n + m - both)


def _sets_and_sketch(size: int):
    """Rows (doc_id, n, cls, sig), and at the end the task's counters in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, kind = np.zeros(1 << SKETCH_BITS, np.uint16), pa.int64()
        names = ["doc_id", "n", "cls", "sig", "block", "counts"]
        for b in batches:
            kind = b.column(0).type
            for s in tv.slices(b.column(1)):
                n, cls, sig, some = [], [], [], []
                for x in tv.shingle_sets(s, size):
                    n.append(len(x))
                    cls.append(class_id(x) if len(x) else None)
                    sig.append(parity(x) if len(x) else None)
                    some.append(x & _U((1 << SKETCH_BITS) - 1))
                at, times = np.unique(np.concatenate(some), return_counts=True)
                # A task's counter stops at 65,535, far above any bound between classes.
                counters[at] = np.minimum(counters[at] + times, 65_535)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary()), pa.nulls(s.n, pa.int32()), pa.nulls(s.n, pa.binary())], names)
        blocks = counters.astype("<u2", copy=False).reshape(-1, _BLOCK)
        for at in np.array_split(np.flatnonzero(blocks.any(1)), 8):
            k = len(at)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(at, pa.int32()), pa.array([blocks[i].tobytes() for i in at], pa.binary())], names)

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(x, "<u2").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def sketch(blocks: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up block by block; 16 MB come to the driver whatever the input."""
    out = np.zeros((1 << SKETCH_BITS) // _BLOCK * _BLOCK, np.int64).reshape(-1, _BLOCK)
    # By shuffle on the block, so no task holds more than its blocks.
    summed = blocks.repartition("block").mapInArrow(_add_blocks, "block int, counts binary")
    for block, counts in summed.collect():
        out[block] += np.frombuffer(counts, "<u4")
    return out.ravel()


def frequency_class(counters: np.ndarray) -> np.ndarray:
    """1 for counters that hold no more than chance would put there, 2 for frequent, 3 for very frequent shingles."""
    mean = counters.mean()
    least = 4 + mean + 5 * np.sqrt(mean)
    return (1 + (counters > least) + (counters > 64 * least)).astype(np.int8)


def keys_of(x: np.ndarray, classes: np.ndarray, top: int, whole: int) -> tuple[np.ndarray, int, bool]:
    """Index keys of a sorted shingle set for similarity ``top / whole``, rare shingles first, how many these are, and whether they are all of its rare ones.

    Proof: let x and y link, so each lacks at most tau of the other's shingles, and
    let x's prefix end first in the global order. At most tau of the prefix's
    shingles aren't in y. The prefix is long enough that, without any tau of them,
    a rare one is left or k of one bucket of class k; these are in y and, as y's prefix
    holds all of y's shingles up to a later end, in y's prefix. Buckets
    depend on the size's level, so keys are given for the levels of all sizes that x can link with.
    """
    n = len(x)
    least = -(-top * n // whole)  # partners hold so many of x's shingles
    tau = n - least
    if not tau and n * whole // top == n:
        return x[:0], 0, False  # no larger partner either: only equal sets link, and these are one class
    kind = classes[(x & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    rare = x[kind == 1]
    if len(rare) > tau:
        return rare[: tau + 1], tau + 1, len(rare) == tau + 1
    out = [rare]
    levels = {least.bit_length(), n.bit_length(), (n * whole // top).bit_length()}
    for level in range(min(levels), max(levels) + 1):
        buckets = max(1, (1 << level) // 24)
        left = tau + 1 - len(rare)
        for k in (2, 3):
            held: dict[int, list[int]] = {}
            for t in x[kind == k].tolist():
                if left <= 0:
                    break
                group = held.setdefault((t >> 20) % buckets, [])
                if len(group) >= k - 1:
                    left -= 1
                group.append(t)
            found = [combination for group in held.values() for combination in combinations(group, k)]
            if found:
                c = np.array(found, dtype=_U)
                h = np.full(len(c), level * 8 + k, _U)
                for i in range(k):
                    h = tv.mix(h * _U(0x9E3779B97F4A7C15) + c[:, i])
                out.append(h)
    return np.concatenate(out), len(rare), True


def combinations(group: list[int], k: int):
    from itertools import combinations as all_of

    return all_of(group, k)


def _held(bits: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Which hashes (signed) may be in a bitmap of ``1 << size`` bits."""
    at = h & ((1 << size) - 1)
    return (bits[at >> 6] >> (h & 63).astype(_U)) & _U(1) != 0


def _entries(size: int, top: int, whole: int, shared, some=None):
    """(key, cls, n) of each class that a task meets, once; with a bitmap ``some`` only keys that may be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = shared.value, set()
        held = None if some is None else some.value
        for b in batches:
            for s in tv.slices(b.column(0)):
                key, rows = [], []
                for x in tv.shingle_sets(s, size):
                    cls = class_id(x) if len(x) else None
                    if cls is None or cls in seen:
                        continue
                    seen.add(cls)
                    k = tv.signed(keys_of(x, classes, top, whole)[0])
                    if held is not None:
                        k = k[_held(held, k, KEY_BITS)]
                    if len(k):
                        key.append(k)
                        rows.append((cls, len(x)))
                times = [len(k) for k in key]
                cls, n = (np.repeat(np.array([row[i] for row in rows], t), times) for i, t in enumerate((np.int64, np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key) if key else np.zeros(0, np.int64)), pa.array(cls), pa.array(n)], ["key", "cls", "n"])

    return run


def _bitmap(needed: DataFrame, hashed: Column, size: int) -> np.ndarray:
    """``1 << size`` bits, set at the hashes; at most a 64th as many rows of two longs come to the driver, whatever the input."""
    at = hashed.bitwiseAND((1 << size) - 1)
    rows = needed.select(F.shiftright(at, 6).alias("i"), F.expr("1L").alias("one"), hashed.bitwiseAND(63).cast("int").alias("place"))
    rows = rows.groupBy("i").agg(F.bit_or(F.expr("shiftleft(one, place)")).alias("bits")).toArrow()
    out = np.zeros((1 << size) // 64, np.int64)
    if rows.num_rows:
        out[rows.column("i").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _texts(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """cls and text, one for each needed class (rep: an id that has the class). A bitmap of bounded size spares most others the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(needed, F.xxhash64("rep"), NEED_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = bits.value, set()
        for b in batches:
            part = b.filter(pa.array(_held(held, b.column(0).to_numpy(), NEED_BITS)))
            for s in tv.slices(part.column(1)):
                at, cls = [], []
                for i, x in enumerate(tv.shingle_sets(s, size), s.first):
                    if len(x) and (c := class_id(x)) not in seen:
                        seen.add(c)
                        at.append(i)
                        cls.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), part.column(1).take(pa.array(at, pa.int64()))], ["cls", "text"])

    found = docs.select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text")).mapInArrow(run, "cls bigint, text string")
    return found.join(needed.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def _linked(x: np.ndarray, y: np.ndarray, top: int, whole: int) -> bool:
    if min(len(x), len(y)) * whole < top * max(len(x), len(y)):
        return False
    both = np.intersect1d(x, y, assume_unique=True).size
    return whole * both >= top * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, texts: DataFrame, size: int, top: int, whole: int) -> DataFrame:
    """Those of the (a, b) that link."""
    one = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, leader_set = None, None
        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            for s in tv.slices(b.column(3)):
                for i, y in enumerate(tv.shingle_sets(s, size), s.first):
                    if a[i] != leader:
                        leader, leader_set = a[i], next(tv.shingle_sets(next(tv.slices(b.column(2).slice(i, 1))), size))
                    if _linked(leader_set, y, top, whole):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([c[i] for i in keep], pa.int64())], ["a", "b"])

    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _sized(n: str, m: str, top: int, whole: int) -> Column:
    return F.least(n, m) * whole >= F.greatest(n, m) * top


def _allowed(pairs: DataFrame, known: DataFrame, top: int, whole: int) -> DataFrame:
    """Those of the (a, b) whose sizes and bitmaps allow a link."""
    side = lambda x, n, sig: known.select(F.col("cls").alias(x), F.col("n").alias(n), F.col("sig").alias(sig))
    both = pairs.join(side("b", "m", "two"), "b").join(side("a", "n", "one"), "a").filter(_sized("n", "m", top, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, m, two = (b.column(i).to_pylist() for i in range(2, 6))
            ok = pa.array([may_link(*x, top, whole) for x in zip(n, one, m, two, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in range(2)], ["a", "b"])

    return both.select("a", "b", "n", "one", "m", "two").mapInArrow(run, "a bigint, b bigint")


def _verified(base: DataFrame, pairs: DataFrame, known: DataFrame, name: str, size: int, top: int, whole: int) -> DataFrame:
    """Those of the (a, b) that link, stored."""
    pairs = stored(_allowed(pairs, known, top, whole), f"{name}-pairs")
    needed = stored(known.select("cls", "rep").join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi"), "needed")
    return stored(_verify(pairs, _texts(base, needed, size), size, top, whole), f"{name}-links")


TILE = 2000


def _overlaps(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """Shared shingles of each set in ``some`` with each set, by products of 0-1 matrices over the shingles met twice."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    twice = n[column] > 1
    number = np.cumsum(n > 1) - 1
    row, column = row[twice], number[column[twice]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(some), len(sets)), np.float32)
    width = 1024
    for c in range(0, int((n > 1).sum()), width):
        at = slice(*np.searchsorted(column, [c, c + width]))
        m = np.zeros((len(sets), width), np.float32)
        m[row[at], column[at] - c] = 1
        out += m[some] @ m.T
    return out


def _outside_first(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, component (numbered) and side of a rectangle's rows."""
    _, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
    return table.column("cls").to_numpy(), root, table.column("outside").to_numpy(zero_copy_only=False).astype(bool)


def _maybe(top: int, whole: int):
    """The members of a rectangle that its bitmaps allow to link with a member of another component."""

    def run(table: pa.Table) -> pa.Table:
        cls, root, outside = _outside_first(table)
        n, sig = table.column("n").to_numpy(), table.column("sig").to_pylist()
        bits = np.array([len(x) * 8 for x in sig])
        hit = np.zeros(len(cls), bool)
        for to in np.unique(bits):
            # Linked sets are of sizes 4 : 5 at most apart, so their bitmaps of one size or of neighbouring ones.
            here = np.flatnonzero((bits >= to) & (bits <= to * (2 if top * 2 >= whole else 1 << 40)))
            to = int(to)
            words = np.frombuffer(b"".join(_folded(int.from_bytes(sig[i], "little"), int(bits[i]), to).to_bytes(to // 8, "little") for i in here), np.uint64).reshape(len(here), -1)
            own = bits[here] == to
            some = np.flatnonzero(outside[here])
            step = max(1, (4 << 20) // max(1, words.size))
            for c in range(0, len(some), step):
                part = some[c : c + step]
                differ = np.bitwise_count(words[part][:, None, :] ^ words[None]).sum(2, dtype=np.int64)
                total = n[here][part][:, None] + n[here]
                both = (total - differ) // 2
                ok = (whole * both >= top * (total - both)) & (own[part][:, None] | own) & (root[here][part][:, None] != root[here]) & ~outside[here]
                hit[here[part[ok.any(1)]]] = True
                hit[here[ok.any(0)]] = True
        return pa.table({"cls": pa.array(cls[hit], pa.int64())})

    return run


def _tile(size: int, top: int, whole: int):
    """Links across components within one rectangle: enough of them to join what its pairs join."""

    def run(table: pa.Table) -> pa.Table:
        cls, root, outside = _outside_first(table)
        sets = [x for s in tv.slices(table.column("text")) for x in tv.shingle_sets(s, size)]
        length = np.array([len(x) for x in sets])
        found: list[tuple[int, int]] = []
        some = np.flatnonzero(outside)
        for part in np.array_split(some, len(some) // 500 + 1):
            if not len(part):
                continue
            both = _overlaps(sets, part)
            ok = whole * both >= top * (length[part][:, None] + length - both)
            ok &= (root[part][:, None] != root) & ~outside
            for i, j in zip(*np.nonzero(ok), strict=True):
                i = part[i]
                if root[i] != root[j]:
                    found.append((int(cls[i]), int(cls[j])))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def similar_documents(docs: DataFrame, size: int = 5, top: int = 80, whole: int = 100, few: int = 48) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link at similarity ``top / whole`` or more."""
    spark = docs.sparkSession
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    first = stored(base.mapInArrow(_sets_and_sketch(size), f"doc_id {kind}, n bigint, cls bigint, sig binary, block int, counts binary"), "shingle-sets")
    rows = first.filter("block is null").select("doc_id", "n", "cls")
    classes = spark.sparkContext.broadcast(frequency_class(sketch(first.filter("block is not null").select("block", "counts"))))
    known = stored(first.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    entries = lambda some: base.select("text").mapInArrow(_entries(size, top, whole, classes, some), "key bigint, cls bigint, n int")
    shared = entries(None).groupBy("key").agg(F.min("cls").alias("l0"), F.max("cls").alias("l1")).filter("l0 != l1").select("key", "l0")
    shared = stored(shared, "shared-keys")
    keys = spark.sparkContext.broadcast(_bitmap(shared, F.col("key"), KEY_BITS))
    hot = stored(entries(keys).join(shared, "key"), "members")

    # The least class that a class shares a key with is mostly the same for all of a group of copies.
    star = hot.filter("cls != l0").groupBy("cls").agg(F.min("l0").alias("a")).select("a", F.col("cls").alias("b"))
    star = stored(star, "leaders")
    links = _verified(base, star, known, "leader", size, top, whole)

    # What is left: keys that still hold several components.
    rooted = hot.select("key", "cls", "n").join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = stored(rooted, "rooted")
    several = stored(rooted.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("key", "members"), "open-keys")
    left = stored(_in_bitmap(rooted, several).join(several, "key"), "open-members")
    small = left.filter(F.col("members") <= few)
    x = small.select("key", F.col("cls").alias("a"), "n", F.col("root").alias("ra"))
    y = small.select("key", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("root").alias("rb"))
    pairs = x.join(y, "key").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _sized("n", "m", top, whole)).select("a", "b").distinct()
    more = _verified(base, pairs.join(star, ["a", "b"], "left_anti"), known, "rest", size, top, whole)

    tiles = _tiled(left.filter(F.col("members") > few), base, known, size, top, whole)
    found = links.unionByName(more) if tiles is None else links.unionByName(more).unionByName(tiles)
    # Nodes begin with the least id of their class, so that a component's root tells its least id.
    node = known.select("cls", F.struct(F.col("rep").isNull().alias("unknown"), "rep", "cls").alias("node"))
    named = found.join(node.toDF("a", "x"), "a").join(node.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    root = components(named).select(F.col("node.cls").alias("cls"), F.col("root.rep").alias("least"))
    placed = rows.filter("cls is not null").join(known.select("cls", "rep").join(root, "cls", "left").select("cls", F.coalesce("least", "rep").alias("least")), "cls")
    alone = rows.filter("cls is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id")).unionByName(alone)


def _in_bitmap(members: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key may be one of ``keys``, found without a shuffle."""
    bits = members.sparkSession.sparkContext.broadcast(_bitmap(keys, F.col("key"), KEY_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_held(bits.value, b.column(0).to_numpy(), KEY_BITS)))

    members = members.select("key", "cls", "n", "root")
    return members.mapInArrow(run, members.schema)


def _tiled(large: DataFrame, base: DataFrame, known: DataFrame, size: int, top: int, whole: int) -> DataFrame | None:
    """Links found in rectangles of the large keys' members; None if there are none."""
    if large.limit(1).count() == 0:
        return None
    # Keys of one main component hold much the same members: each is taken once for all of them.
    main = large.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "root")).getField("root").alias("main"))
    once = stored(large.join(main, "key").select("main", "cls", "root").distinct(), "large-members")
    maybe = stored(_rectangles(once, known.select("cls", "n", "sig")).applyInArrow(_maybe(top, whole), "cls bigint").distinct(), "large-maybe")
    needed = stored(known.select("cls", "rep").join(maybe, "cls", "left_semi"), "needed")
    return stored(_rectangles(once.join(maybe, "cls", "left_semi"), _texts(base, needed, size)).applyInArrow(_tile(size, top, whole), "a bigint, b bigint"), "large-links")


def _rectangles(once: DataFrame, more: DataFrame):
    """Groups (main, i, j): the i-th part of a main component's rows against the j-th of those outside it (outside is true)."""
    away = F.col("root") != F.col("main")
    cuts = once.groupBy("main").agg(F.ceil(F.count("*") / TILE).cast("int").alias("all"), F.ceil(F.sum(away.cast("int")) / TILE).cast("int").alias("out"))
    sized = once.join(cuts, "main")
    h = F.xxhash64("cls", "main")
    part = lambda n: F.pmod(h, F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = sized.select("main", part("all").alias("i"), each("out").alias("j"), "cls", "root", F.lit(False).alias("outside"))
    outer = sized.filter(away).select("main", each("all").alias("i"), part("out").alias("j"), "cls", "root", F.lit(True).alias("outside"))
    return inner.filter("j >= 0").unionByName(outer).join(more, "cls").groupBy("main", "i", "j")
