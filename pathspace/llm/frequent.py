"""The most frequent rows of a counted table, without sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_most(df: DataFrame, n: str, most: int) -> float:
    """The least count such that at most ``most`` rows have it or more, from a histogram of a few hundred levels."""
    step = F.floor(F.log2(n) * 16)
    least, total = None, 0
    for level, k in df.groupBy(step.alias("level")).count().orderBy(F.desc("level")).collect():
        if total + k > most:
            break
        least, total = level, total + k
    return float("inf") if least is None else 2 ** (least / 16) * (1 - 1e-12)
