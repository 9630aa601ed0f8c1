"""Array-of-number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """Unit-length array of doubles; the norm is floored so that a zero row stays zero.

    The norm is repeated as an array so that it is computed once per row, not once per element.
    """
    norm = F.array_repeat(F.greatest(l2_norm(v), F.lit(floor)), F.size(v))
    return F.zip_with(v, norm, lambda x, n: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
