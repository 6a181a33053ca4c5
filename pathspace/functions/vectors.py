"""Vector and text expressions (columns in, column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """For unit vectors."""
    return F.lit(1.0) - dot(a, b)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def text_key(text: Column, whole: bool = False) -> Column:
    """Key under which candidates merge: the first 200 characters, or the whole text, in lower case without outer white space."""
    return F.regexp_replace(F.lower(text if whole else F.substring(text, 1, 200)), r"^\s+|\s+$", "")


def first_filled(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def doubles(a: Column) -> Column:
    return a.cast("array<double>")
