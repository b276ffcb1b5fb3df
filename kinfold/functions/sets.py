"""Set measures over array<string> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present, unique


def overlap(a: Column, b: Column) -> Column:
    """Common items over the larger set's size, of the distinct items; 0 if either is empty."""
    x, y = unique(a), unique(b)
    both = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both).otherwise(F.lit(0.0))


def overlap_of_distinct(x: Column, y: Column) -> Column:
    """The same of arrays that are known to be distinct and without nulls."""
    both = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both).otherwise(F.lit(0.0))


def disjoint(a: Column, b: Column) -> Column:
    """Both have items and none is common."""
    x, y = present(a), present(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def top_item(items: Column) -> Column:
    """The most frequent item, the first seen of equals; null if there is none."""
    kept = present(items)
    ranked = F.transform(F.array_distinct(kept), lambda x: F.struct(F.size(F.filter(kept, lambda y: y == x)).alias("n"), (-F.array_position(kept, x)).alias("at"), x.alias("item")))
    return F.array_max(ranked)["item"]
