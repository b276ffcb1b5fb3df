"""Vector scalars over array<double> columns, and their numpy forms for block kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def normalized(v: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size == 0, v).otherwise(F.transform(v, lambda x: x / size))


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    x, y = _common(a, b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """With lengths over the shorter part; 0 where either is 0."""
    x, y = _common(a, b)
    size = norm(x) * norm(y)
    return F.when(size > 0, dot(x, y) / size).otherwise(F.lit(0.0))


def cosine_full(a: Column, b: Column) -> Column:
    """The dot product over the shorter part, but lengths over the whole vectors."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def combined(parts: list[tuple[Column, Column]]) -> Column:
    """Unit vector of the weighted sum of (vector, weight) parts.

    Null or empty vectors and weights of 0 drop out, the other weights are scaled to sum 1, vectors are cut to the shortest
    of those that stay. Without any part the result is empty.
    """
    empty = F.array().cast("array<double>")
    used = F.filter(F.array(*(F.struct(F.coalesce(v, empty).alias("v"), w.cast("double").alias("w")) for v, w in parts)), lambda p: (F.size(p["v"]) > 0) & (p["w"] > 0))
    n = F.array_min(F.transform(used, lambda p: F.size(p["v"])))
    total = F.aggregate(used, F.lit(0.0), lambda s, p: s + p["w"])
    zero = F.array_repeat(F.lit(0.0), n)
    added = F.aggregate(used, zero, lambda s, p: F.zip_with(s, F.slice(p["v"], F.lit(1), n), lambda x, y: x + y * (p["w"] / total)))
    return F.when(F.size(used) > 0, normalized(added)).otherwise(empty)
