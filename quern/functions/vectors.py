"""Vector similarity as Column expressions on arrays, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def negated_distance(a: Column, b: Column) -> Column:
    """Euclidean distance with its sign turned, so that larger is closer."""
    return -F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def unit(a: Column) -> Column:
    """The vector over its norm, which is computed once for all components; a zero vector stays."""
    v = doubles(a)
    return F.zip_with(v, F.array_repeat(norm(a), F.size(v)), lambda x, size: F.when(size > 0, x / size).otherwise(0.0))
