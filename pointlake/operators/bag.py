"""A bag of points: membership, insertion, removal of one occurrence."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, axes: list[str]):
    return reduce(and_, [left[a].eqNullSafe(right[a]) for a in axes])


def contains(df: DataFrame, point: dict) -> bool:
    """Whether some row equals the point on all its axes."""
    return not df.filter(reduce(and_, [F.col(a).eqNullSafe(F.lit(v)) for a, v in point.items()])).limit(1).isEmpty()


def contained(df: DataFrame, points: DataFrame, axes: list[str]) -> DataFrame:
    """The rows of ``points`` that occur in ``df``."""
    return points.join(df.select(*axes), _same(points, df, axes), "left_semi")


def not_contained(df: DataFrame, points: DataFrame, axes: list[str]) -> DataFrame:
    return points.join(df.select(*axes), _same(points, df, axes), "left_anti")


def insert(df: DataFrame, points: DataFrame) -> DataFrame:
    """Bag union: equal points stay as many rows."""
    if sorted(df.columns) != sorted(points.columns):
        raise ValueError(f"columns {points.columns} into {df.columns}")
    return df.unionByName(points)


def remove(df: DataFrame, points: DataFrame) -> DataFrame:
    """Take one equal row away for each row of ``points``; missing ones are passed over."""
    return df.exceptAll(points.select(*df.columns))


def remove_strict(df: DataFrame, points: DataFrame) -> DataFrame:
    """``remove``, but ValueError if a point is not there often enough. Runs a job."""
    missing = points.select(*df.columns).exceptAll(df).limit(1).collect()
    if missing:
        raise ValueError(f"not in the bag: {missing[0]}")
    return remove(df, points)


def split_three_ways(df: DataFrame, axis: str, value) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows below, at and above ``value``."""
    c, v = F.col(axis), F.lit(value)
    return df.filter(c < v), df.filter(c == v), df.filter(c > v)
