"""Intervals and axis-aligned boxes: plain values that turn into predicates.

An interval is half-open, [lo, hi); None leaves a side unbounded. Both kinds of
object are immutable, so no copy operation is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    lo: Any = None
    hi: Any = None

    @property
    def empty(self) -> bool:
        return self.lo is not None and self.hi is not None and self.lo >= self.hi

    def __contains__(self, value: Any) -> bool:
        return (self.lo is None or value >= self.lo) and (self.hi is None or value < self.hi)

    def contains(self, other: Interval) -> bool:
        """Whether the closed range ``other`` lies inside this half-open one."""
        low = self.lo is None or (other.lo is not None and other.lo >= self.lo)
        return low and (self.hi is None or (other.hi is not None and other.hi < self.hi))

    def is_disjoint_from(self, other: Interval) -> bool:
        """Whether the closed ranges have no value in common; touching ranges do."""
        after = lambda a, b: a.lo is not None and b.hi is not None and a.lo > b.hi
        return after(self, other) or after(other, self)

    def matches(self, value: Column, floating: bool = False) -> Column:
        """Predicate on ``value``: null is never inside, nor is NaN of a floating axis."""
        if self.empty:
            return F.lit(False)
        parts = [value.isNotNull()]
        if floating and self.hi is None:
            parts.append(~F.isnan(value))
        if self.lo is not None:
            parts.append(value >= F.lit(self.lo))
        if self.hi is not None:
            parts.append(value < F.lit(self.hi))
        return reduce(and_, parts)


def interval_contains(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Column form of ``Interval.contains`` for bounded ranges."""
    return (b_lo >= a_lo) & (b_hi < a_hi)


def interval_disjoint(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Column form of ``Interval.is_disjoint_from`` for bounded ranges."""
    return (a_lo > b_hi) | (b_lo > a_hi)


def box_contains(pairs: list[tuple[Column, Column, Column, Column]]) -> Column:
    return reduce(and_, [interval_contains(*p) for p in pairs])


def box_disjoint(pairs: list[tuple[Column, Column, Column, Column]]) -> Column:
    """Two boxes are apart as soon as they are on one axis."""
    return reduce(or_, [interval_disjoint(*p) for p in pairs])


@dataclass(frozen=True)
class Box:
    """One interval for each named axis, in order."""

    axes: tuple[tuple[str, Interval], ...]

    @classmethod
    def of(cls, **intervals: tuple[Any, Any]) -> Box:
        return cls(tuple((axis, Interval(*bounds)) for axis, bounds in intervals.items()))

    @classmethod
    def from_bounds(cls, axes: list[str], bounds: list[tuple[Any, Any]]) -> Box:
        if len(axes) != len(bounds):
            raise ValueError(f"{len(axes)} axes but {len(bounds)} bounds")
        return cls(tuple((a, Interval(*b)) for a, b in zip(axes, bounds, strict=True)))

    def __len__(self) -> int:
        return len(self.axes)

    def __iter__(self):
        return iter(interval for _, interval in self.axes)

    def __getitem__(self, axis: str) -> Interval:
        return dict(self.axes)[axis]

    def __contains__(self, point) -> bool:
        if len(point) != len(self):
            raise ValueError(f"a point of {len(point)} values in a box of {len(self)} axes")
        return all(v in interval for v, interval in zip(point, self, strict=True))

    def suffix(self, first: int) -> Box:
        """The box on the axes from position ``first`` on."""
        return Box(self.axes[first:])

    def _paired(self, other: Box):
        if [a for a, _ in self.axes] != [a for a, _ in other.axes]:
            raise ValueError("boxes of different axes")
        return zip(self, other, strict=True)

    def contains(self, other: Box) -> bool:
        return all(a.contains(b) for a, b in self._paired(other))

    def is_disjoint_from(self, other: Box) -> bool:
        return any(a.is_disjoint_from(b) for a, b in self._paired(other))

    def split(self, axis: str, at: Any) -> tuple[Box, Box]:
        """The parts below and from ``at`` on."""
        whole = self[axis]
        if at not in whole:
            raise ValueError(f"{at!r} is outside {whole}")
        put = lambda part: Box(tuple((a, part if a == axis else i) for a, i in self.axes))
        return put(Interval(whole.lo, at)), put(Interval(at, whole.hi))
