"""Vector algebra on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    """v over its length; a length under `least` counts as that."""
    return F.transform(doubles(v), lambda x: x / F.greatest(norm(v), F.lit(least)))


def lerp(a: Column, b: Column, weight: float) -> Column:
    """(1 - weight) * a + weight * b."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * (1 - weight) + y * weight)


def largest(v: Column) -> Column:
    """Largest absolute value."""
    return F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))


def groups(v: Column, size: int) -> Column:
    """v in groups of `size`; the last one may be shorter."""
    n = F.ceil(F.size(v) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.slice(v, g * size + 1, F.lit(size)))
