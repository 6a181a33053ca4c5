"""Thin wrappers around mapInArrow for operators that add columns computed from a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def rows_of(batch: pa.RecordBatch, keep: list[str], first: int, n: int) -> dict[str, pa.Array]:
    return {c: batch.column(c).slice(first, n) for c in keep}


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: T.StructType | str) -> DataFrame:
    """Apply ``f`` to each Arrow batch; it yields column dicts in the order of ``schema``."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for out in f(b):
                arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (out[c] for c in names)]
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays], names)

    return df.mapInArrow(run, schema)
