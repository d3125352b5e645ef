"""Expressions over vectors stored as arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The product of doubles summed in dimension order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot of unit vectors, clipped to [0, 2] before anything is sorted by it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - dot(a, b)))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def normalised(v: Column) -> Column:
    """v at unit length; null if its norm is zero or not finite."""
    norm = F.sqrt(squared_norm(v))
    ok = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(ok, F.transform(v, lambda x: x.cast("double") / norm))


def is_unit(v: Column, tolerance: float = 1e-5) -> Column:
    n = F.sqrt(squared_norm(v))
    return ~F.isnan(n) & (F.abs(n - 1) <= tolerance)
