"""Vector columns: validity, norms and pairwise measures as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(c: Column, dim: int) -> Column:
    """Not null, of length ``dim`` and without null, NaN or infinite items."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) == dim) & ~bad, F.lit(False))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda total, x: total + x)


def norm(c: Column) -> Column:
    return F.sqrt(_sum(F.transform(c, lambda x: x.cast("double") * x.cast("double"))))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors of equal length."""
    return _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either vector is all zero."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
