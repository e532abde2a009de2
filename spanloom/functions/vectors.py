"""Column functions on vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.operators.retrieval import dot


def l2_norm(v: Column) -> Column:
    """The length of a vector; 1 for a vector of zeros, so that it can divide."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def normalised(v: Column) -> Column:
    """A vector of length 1 in its direction; zeros stay zeros."""
    n = l2_norm(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one is all zeros."""
    return dot(a, b) / (l2_norm(a) * l2_norm(b))
