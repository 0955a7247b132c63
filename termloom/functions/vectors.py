"""Vector functions as Spark columns over ARRAY<FLOAT>, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; a zero vector stays as it is."""
    n = norm(a)
    n = F.when(n == 0, 1.0).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either length is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def weighted_jaccard(a: Column, b: Column, weights: Column) -> Column:
    """Sum of the weights of common values over that of all values; a value without weight counts 1."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(weights, x), F.lit(1.0)))
    den = total(F.array_union(a, b))
    return F.when(den == 0, 0.0).otherwise(total(F.array_intersect(a, b)) / den)
