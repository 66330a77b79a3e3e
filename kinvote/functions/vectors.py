"""Arithmetic on array columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to each norm of a cosine distance, so that zero vectors have distance 1.
EPSILON = 1e-9


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """Euclidean length of an array of doubles."""
    return F.sqrt(dot(a, a))


def doubles(a: Column | str) -> Column:
    """An array of floats as an array of doubles."""
    return F.transform(a, lambda x: x.cast("double"))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def finite(a: Column, dim: int | None = None) -> Column:
    """Whether an array is not null, has ``dim`` elements (if given) and only finite numbers."""
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sized = F.size(a) == dim if dim is not None else F.size(a) > 0
    return F.coalesce(a.isNotNull() & sized & fine, F.lit(False))
