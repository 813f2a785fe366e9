"""Similarities of two rows, from word sets and dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ochiai(a: Column, b: Column) -> Column:
    """Common words by the geometric mean of both sets' sizes; 0 where one is empty."""
    product = F.size(a).cast("double") * F.size(b)
    return F.when(product > 0, F.size(F.array_intersect(a, b)) / F.sqrt(product)).otherwise(F.lit(0.0))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - common by all words; 0 if both sets are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, 1 - F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(0.0))


def share_of(a: Column, b: Column) -> Column:
    """Which part of a's distinct entries b has; 0 if a is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or vectors of different length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, between 0 and 2; 1 for a zero vector or vectors of different length."""
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))
