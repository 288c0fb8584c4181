"""Bounds and extremal points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(df: DataFrame, axes: list[str], by: list[str] | None = None) -> DataFrame:
    """One row of min_<axis> and max_<axis>, or one for each region ``by``; null for an empty table."""
    return df.groupBy(*(by or [])).agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def min_value(df: DataFrame, axis: str):
    return df.agg(F.min(axis)).first()[0]


def max_value(df: DataFrame, axis: str):
    return df.agg(F.max(axis)).first()[0]


def min_point(df: DataFrame, axis: str, id_col: str) -> DataFrame:
    """The row with the least coordinate; of several the least id."""
    return df.filter(F.col(axis).isNotNull()).orderBy(axis, id_col).limit(1)


def max_point(df: DataFrame, axis: str, id_col: str) -> DataFrame:
    return df.filter(F.col(axis).isNotNull()).orderBy(F.col(axis).desc(), id_col).limit(1)


def spread(df: DataFrame, axes: list[str]) -> DataFrame:
    """Population standard deviation and median of each axis, which rank split candidates."""
    return df.agg(
        *[F.stddev_pop(a).alias(f"stddev_{a}") for a in axes],
        *[F.percentile_approx(a, 0.5, 100_000).alias(f"median_{a}") for a in axes],
    )


def median(df: DataFrame, axis: str, room: int = 100_000):
    """The exact lower median of an axis; None for an empty one.

    Approximate quantiles close in on it until ``room`` rows or one value are left; no pass
    shuffles more than counts.
    """
    values = df.select(F.col(axis).alias("v")).filter("v is not null")
    left = values.count()
    if not left:
        return None
    nth = (left - 1) // 2
    while left > room:
        near = [max(0.0, (nth - left / 1000) / left), min(1.0, (nth + 1 + left / 1000) / left)]
        low, high = values.agg(F.percentile_approx("v", near, 10_000)).first()[0]
        below, inside = values.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not below <= nth < below + inside or inside == left:
            break
        if low == high:
            return low
        values, nth, left = values.filter(F.col("v").between(low, high)), nth - below, inside
    return values.orderBy("v").offset(nth).limit(1).first()[0]
