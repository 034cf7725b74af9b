"""Column functions over numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def rrf_term(rank: Column, k: int = 60) -> Column:
    """What a rank, from 1, adds to a fused score."""
    return F.lit(1.0) / (F.lit(k) + rank)


def sigmoid(x: Column) -> Column:
    """Stable at either end."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
