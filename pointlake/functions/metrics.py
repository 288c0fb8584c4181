"""Distances as column expressions, for wide points and for vector columns.

A user's own ``Callable[[Column, Column], Column]`` on arrays works wherever a metric
name does; points given as one column an axis come to it as arrays of doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = str | Callable[[Column, Column], Column]


def _power(metric: str) -> float:
    if metric.startswith("minkowski:"):
        p = float(metric.split(":")[1])
        if p < 1:
            raise ValueError("minkowski needs a power of at least 1")
        return p
    raise ValueError(f"unknown metric {metric!r}")


def wide(metric: Metric, a: list[Column], b: list[Column]) -> Column:
    """Distance between points given as one column for each axis."""
    if len(a) != len(b) or not a:
        raise ValueError(f"points of {len(a)} and {len(b)} axes")
    if callable(metric):
        return metric(F.array(*[x.cast("double") for x in a]), F.array(*[x.cast("double") for x in b]))
    gaps = [x.cast("double") - y.cast("double") for x, y in zip(a, b, strict=True)]
    if metric == "l2":
        return F.sqrt(reduce(add, [g * g for g in gaps]))
    if metric == "l1":
        return reduce(add, [F.abs(g) for g in gaps])
    if metric == "linf":
        return F.greatest(*[F.abs(g) for g in gaps], F.lit(0.0))
    p = _power(metric)
    return F.pow(reduce(add, [F.pow(F.abs(g), F.lit(p)) for g in gaps]), F.lit(1 / p))


def vector(metric: Metric, a: Column, b: Column) -> Column:
    """Distance between array columns."""
    if callable(metric):
        return metric(a, b)
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    fold = lambda term: F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + term(g))
    if metric == "l2":
        return F.sqrt(fold(lambda g: g * g))
    if metric == "l1":
        return fold(F.abs)
    if metric == "linf":
        return F.aggregate(gaps, F.lit(0.0), lambda acc, g: F.greatest(acc, F.abs(g)))
    p = _power(metric)
    return F.pow(fold(lambda g: F.pow(F.abs(g), F.lit(p))), F.lit(1 / p))


def lowest_bit(x: Column) -> Column:
    """The value of the lowest set bit."""
    return x.bitwiseAND(-x)
