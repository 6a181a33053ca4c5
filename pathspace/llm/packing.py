"""Best-fit packing of tokenised documents into fixed-length sequences.

Each partition packs its own documents in one pass and in bounded space: a fixed
number of open sequences are kept in a bitset keyed by their free space; a piece
goes to the open sequence with the least free space that holds it; if none does, a
new sequence opens, and when too many are open the fullest closes. Pieces are given out when
their sequence closes, so what a partition holds is bounded by its open sequences.

What is still open when a partition ends is packed anew: the pieces of a few neighbouring partitions
meet in one task, longest first (best-fit decreasing), in the same bounded space. So
a task of the second round gets at most ``together`` times the open sequences of one partition, whatever the input.

Defined results: a null or empty text is the end id alone; a null id stays null; repeated rows, also
with equal ids, are packed each for itself; of equally good sequences the one that came last to that free
space is taken; texts of any length are cut into pieces; empty tables give no rows; columns other than the id and
the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import byte_level
from .store import stored

#: Ids in a batch that leaves a task.
BATCH_BYTES = 1 << 20
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"


class BestFit:
    """Bounded-space online best fit."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.limit = size, open_bins
        self.bits = 0  # bit f is set if some open bin has f places free
        self.at: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.bins = 0

    def _put(self, free: int, bin_: int) -> None:
        self.at[free].append(bin_)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        out = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """The bin and the place in it for a piece of 1 to ``size`` tokens, and the bins that this closes."""
        closed = []
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.size, self.bins
            self.bins += 1
            if self.open >= self.limit and length < free:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest
        if free > length:
            self._put(free - length, bin_)
        else:
            closed.append(bin_)
        return bin_, self.size - free, closed


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: full ones, the first may be shorter."""
    first = (total - 1) % size + 1
    return [(0, first)] + [(s, size) for s in range(first, total, size)]


def _packed(pieces: Iterator[tuple], size: int, open_bins: int, base: int) -> Iterator[pa.RecordBatch]:
    """Batches of the pieces (doc_id, piece, start, length, ids) with their sequence and offset, by closing sequences; ``open`` marks those left at the end."""
    bins = BestFit(size, open_bins)
    held: dict[int, list[tuple]] = {}
    out: list[list] = [[] for _ in NAMES]
    bytes_ = 0

    def give(bin_: int, still_open: bool) -> int:
        rows = held.pop(bin_)
        for row, offset in rows:
            for column, x in zip(out, (*row, base + bin_, offset, still_open), strict=True):
                column.append(x)
        return sum(len(row[4]) for row, _ in rows)

    for row in pieces:
        bin_, offset, closed = bins.place(row[3])
        held.setdefault(bin_, []).append((row, offset))
        for c in closed:
            bytes_ += give(c, False)
        if bytes_ > BATCH_BYTES:
            yield _batch(out)
            out, bytes_ = [[] for _ in NAMES], 0
    for c in list(held):
        bytes_ += give(c, True)
        if bytes_ > BATCH_BYTES:
            yield _batch(out)
            out, bytes_ = [[] for _ in NAMES], 0
    if out[0]:
        yield _batch(out)


def pack(docs: DataFrame, path: str, size: int = 2048, open_bins: int = 1024, end_id: int = 0, together: int = 8) -> DataFrame:
    """Pieces with their ids (32-bit little-endian) and their place in a sequence: doc_id, piece, start, length, ids, sequence_id, offset."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder, end = byte_level(path), end_id.to_bytes(4, "little")
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    yield doc_id, k, start, length, ids[4 * start : 4 * (start + length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(pieces(batches), size, open_bins, TaskContext.get().partitionId() << 40)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for s in range(0, b.num_rows, 500) for row in zip(*(b.column(i).slice(s, 500).to_pylist() for i in range(5)), strict=True))
        # The second round's sequences are numbered from 2**39 on in their partition.
        yield from _packed(rows, size, open_bins, (TaskContext.get().partitionId() << 40) + (1 << 39))

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stored(base.mapInArrow(run, SCHEMA + ", open boolean"), "packed")
    rest = first.filter("open").withColumn("group", F.floor(F.shiftright("sequence_id", 40) / together).cast("int"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = rest.repartition(tasks, "group").sortWithinPartitions(F.desc("length"), "doc_id", "piece").select(*NAMES[:5])
    return first.filter("not open").drop("open").unionByName(rest.mapInArrow(again, SCHEMA + ", open boolean").drop("open"))


def fill(packed: DataFrame, size: int = 2048) -> DataFrame:
    """sequences, tokens, least (the fewest sequences that could hold them), filled (tokens over the sequences' room)."""
    total = packed.agg(F.count_distinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens"))
    return total.withColumn("least", F.ceil(F.col("tokens") / size)).withColumn("filled", F.col("tokens") / (F.col("sequences") * size))


NAMES = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "open"]


def _batch(c: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], NAMES)
