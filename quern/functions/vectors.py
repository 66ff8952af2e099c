"""Column expressions over array<double> vectors. Zero vectors have cosine similarity 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "squared_euclidean", "manhattan")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def mean(x: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(x), F.size(x))


def cosine(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(dot(x, y), norm(x) * norm(y)), F.lit(0.0))


def distance(x: Column, y: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - cosine(x, y)
    if metric == "manhattan":
        return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))
    squared = total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))
    if metric == "squared_euclidean":
        return squared
    if metric == "euclidean":
        return F.sqrt(squared)
    raise ValueError(f"unknown metric {metric}")


def softmax_mean(logits: Column, first: float = 0.0) -> Column:
    """Expectation of first, first + 1, ... under the softmax of the logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    return F.try_divide(F.aggregate(F.zip_with(e, F.transform(logits, lambda _, i: i + F.lit(first)), lambda p, i: p * i), F.lit(0.0), lambda a, v: a + v), total(e))
