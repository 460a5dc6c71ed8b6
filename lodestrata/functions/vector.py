"""Vector arithmetic over array<float> columns in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def mean(a: Column) -> Column:
    return F.try_divide(_sum(F.transform(a, lambda x: x.cast("double"))), F.size(a).cast("double"))


def variance(a: Column) -> Column:
    """Of the population."""
    m = mean(a)
    return F.try_divide(_sum(F.transform(a, lambda x: F.pow(x.cast("double") - m, F.lit(2.0)))), F.size(a).cast("double"))


def usable(a: Column, dim: int) -> Column:
    """Of length dim, every value a number, not all zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce((F.size(a) == dim) & ~bad & F.exists(a, lambda x: x != 0), F.lit(False))


def score_from_distance(d: Column) -> Column:
    """1 - d for a distance in [0, 1], else 1 / (1 + d); null gives 0. Not monotone at 1: that is the contract."""
    return F.when(d.isNull(), 0.0).when(d.between(0.0, 1.0), 1.0 - d).otherwise(1.0 / (1.0 + F.greatest(F.lit(0.0), d)))
