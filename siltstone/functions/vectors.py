"""Column -> Column functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot_product(a: Column, b: Column) -> Column:
    """Over as many places as the shorter has; 0 if either is empty or null."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(a.isNotNull() & b.isNotNull() & (n > 0), _sum(both)).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for lengths that differ, empty vectors and vectors of zeros."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot_product(a, b) / F.nullif(size, F.lit(0.0))).otherwise(0.0)
