"""Orthogonal range search: one box, slices, and a table of boxes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.operators.model import Box, Interval

_FLOATS = (T.FloatType, T.DoubleType)


def box_predicate(df: DataFrame, box: Box) -> Column:
    """AND of the box's intervals; an empty interval makes it false at plan time."""
    missing = [axis for axis, _ in box.axes if axis not in df.columns]
    if missing:
        raise ValueError(f"no such axes: {missing}")
    if not len(box):
        raise ValueError("a box without axes")
    if any(i.empty for i in box):
        return F.lit(False)
    parts = [i.matches(F.col(a), isinstance(df.schema[a].dataType, _FLOATS)) for a, i in box.axes]
    return reduce(and_, parts)


def range_search(df: DataFrame, box: Box) -> DataFrame:
    """Rows whose coordinates all lie in the box; pushed down to the scan."""
    return df.filter(box_predicate(df, box))


def vector_range_search(df: DataFrame, vector: str, bounds: dict[int, Interval]) -> DataFrame:
    """``range_search`` on components (from 0) of an array column."""
    parts = [i.matches(F.get(F.col(vector), F.lit(k)), floating=True) for k, i in bounds.items()]
    return df.filter(reduce(and_, parts))


def slice_range(df: DataFrame, axis: str, start=None, stop=None) -> DataFrame:
    """Rows with start <= axis < stop; None is unbounded."""
    if any(isinstance(x, (tuple, list)) for x in (start, stop)):
        raise TypeError("a slice has a single start and a single stop")
    if start is not None and stop is not None and start > stop:
        raise IndexError(f"start {start!r} after stop {stop!r}")
    return range_search(df, Box(((axis, Interval(start, stop)),)))


def lower_bound(df: DataFrame, axis: str, value) -> DataFrame:
    """The least coordinate not below ``value``, as one row (null if none)."""
    return df.filter(F.col(axis) >= F.lit(value)).agg(F.min(axis).alias(axis))


def batch_range_search(points: DataFrame, boxes: DataFrame, axes: dict[str, tuple[str, str]]) -> DataFrame:
    """Inner join of points with the boxes that hold them.

    ``axes`` maps a point column to the boxes' (lo, hi) columns. The first axis is
    binned: a box goes to the level whose bins are at least as wide as the box, hence to
    two bins at most, and a point to its bin on each level that occurs. The rest is a
    residual filter. A box of any width thus costs two rows, and neither side must fit
    in memory. Boxes that are null, NaN or empty on an axis match nothing; unbounded
    sides are given as infinities, and are binned where the points end.
    """
    (first, (lo, hi)), *_ = axes.items()
    number = lambda c: F.col(c).cast("double")
    usable = reduce(and_, [(F.col(a) < F.col(b)) & ~F.isnan(number(a)) & ~F.isnan(number(b)) for a, b in axes.values()])
    real = points.filter(F.col(first).isNotNull() & ~F.isnan(number(first)))
    finite = F.when(F.abs(number(first)) < F.lit(float("inf")), number(first))
    least, most = real.agg(F.min(finite), F.max(finite)).first()
    least, most = (0.0, 0.0) if least is None else (least, most)
    clamp = lambda c: F.greatest(F.lit(least), F.least(F.lit(most), number(c))) - F.lit(least)
    # bins are no narrower than a millionth of the points' extent, so levels are few
    width = F.greatest(clamp(hi) - clamp(lo), F.lit(max((most - least) * 2.0**-20, 1e-300)))
    level = F.ceil(F.log2(width)).cast("int")
    level = F.when(F.pow(F.lit(2.0), level) < width, level + 1).otherwise(level)
    leveled = boxes.filter(usable).withColumn("_level", level)
    some = sorted(r[0] for r in leveled.select("_level").distinct().collect())

    def bin_of(c: str, at: Column | int) -> Column:
        return F.floor(clamp(c) / F.pow(F.lit(2.0), F.lit(at) if isinstance(at, int) else at)).cast("long")

    spread = leveled.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(lo, F.col("_level")), bin_of(hi, F.col("_level"))))))
    inside = reduce(and_, [(F.col(p) >= F.col(a)) & (F.col(p) < F.col(b)) for p, (a, b) in axes.items()])
    keys = F.array(*[F.struct(F.lit(x).alias("l"), bin_of(first, x).alias("b")) for x in some]) if some else F.array().cast("array<struct<l:int,b:bigint>>")
    exploded = real.withColumn("_k", F.explode(keys)).withColumns({"_pl": F.col("_k.l"), "_pb": F.col("_k.b")}).drop("_k")
    hit = exploded.join(spread, (F.col("_pl") == F.col("_level")) & (F.col("_pb") == F.col("_bin")) & inside)
    return hit.drop("_pl", "_pb", "_level", "_bin")
