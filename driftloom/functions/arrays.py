"""Arrays of numbers and axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.nullif(F.size(a).cast("double"), F.lit(0.0))


def array_std(a: Column) -> Column:
    """Population standard deviation of an array."""
    mean = array_mean(a)
    spread = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - mean) * (x.cast("double") - mean))
    return F.sqrt(spread / F.nullif(F.size(a).cast("double"), F.lit(0.0)))


def sanitized(a: Column) -> Column:
    """Without null, zero and non-finite entries."""
    return F.filter(a, lambda x: x.isNotNull() & (x != 0) & ~F.isnan(x) & (F.abs(x) < float("inf")))


def linspace(low: Column, high: Column, n: Column) -> Column:
    """n + 1 edges from low to high."""
    return F.transform(F.sequence(F.lit(0), n), lambda i: low + i * (high - low) / n)


def midpoints(edges: Column) -> Column:
    return F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: (a + b) / 2)


def clamped_bin(x: Column, edges: Column) -> Column:
    """Index of the bin [e_i, e_i+1) of a value; values outside go to the end bins."""
    below = F.size(F.filter(edges, lambda e: e <= x)) - 1
    return F.greatest(F.lit(0), F.least(F.size(edges) - 2, below))


def bin_or_null(x: Column, edges: Column) -> Column:
    """Index of the bin of a value, the last edge included; null outside."""
    inside = (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1))
    return F.when(inside, F.least(F.size(edges) - 2, F.size(F.filter(edges, lambda e: e <= x)) - 1))
