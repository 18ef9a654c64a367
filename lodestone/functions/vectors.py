"""Vector functions over array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, zero or of another length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def normalized(a: Column, epsilon: float = 1e-9) -> Column:
    size = F.greatest(norm(a), F.lit(epsilon))
    return F.transform(a, lambda x: x / size)
