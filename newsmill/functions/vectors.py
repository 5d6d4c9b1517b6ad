"""Vector functions over array columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN for a zero vector, which sorts last."""
    return F.coalesce(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(float("nan")))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def of_size(a: Column, size: int) -> Column:
    """The vector if it has ``size`` entries, else null."""
    return F.when(F.size(a) == size, a)
