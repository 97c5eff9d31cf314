"""Vector arithmetic on array columns, kept inside the JVM and summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def l2_normalize(vec: Column) -> Column:
    """Unit vector; a zero vector stays as it is (its norm counts as 1)."""
    length = norm(vec)
    safe = F.when(length > 0, length).otherwise(F.lit(1.0))
    # beside every component, so that the length is taken once and not for each of them
    return F.zip_with(as_doubles(vec), F.array_repeat(safe, F.size(vec)), lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def fit_dimension(vec: Column, dim: int) -> Column:
    """Pad with zeros or cut to ``dim`` entries."""
    return F.slice(F.concat(as_doubles(vec), F.array_repeat(F.lit(0.0), dim)), 1, dim)
