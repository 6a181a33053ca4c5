"""Batches of texts are bounded in bytes."""

from pyspark.sql import functions as F

from pathspace.llm import packing
from pathspace.llm.store import small_batches


def test_batches_are_bounded_by_bytes(spark):
    small_batches(spark)
    big = spark.range(0, 600, 1, 1).select(F.col("id"), F.repeat(F.lit("x"), 50_000).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    got = big.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 600 and max(r.bytes for r in got) < 6 << 20


def test_packed_batches_are_small_and_whole():
    rows = [(i, 0, 0, 900, b"x" * 3_600) for i in range(3_000)]
    got = list(packing._packed(iter(rows), 2_048, 16, 0))
    assert sum(b.num_rows for b in got) == 3_000 and max(b.nbytes for b in got) < 2 << 20
    assert sorted(x for b in got for x in b.column(0).to_pylist()) == list(range(3_000))
