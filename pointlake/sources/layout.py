"""Physical layout: what makes box and distance filters skip data.

Files whose rows lie close together have narrow min/max statistics, so the scan's
pushed filters drop whole files and row groups. These writers cluster rows; they
never change results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions import metrics


def clustered(df: DataFrame, axis: str, partitions: int) -> DataFrame:
    """Range-partitioned and sorted on one axis."""
    return df.repartitionByRange(partitions, axis).sortWithinPartitions(axis)


def z_order(df: DataFrame, axes: list[str], bits: int = 10) -> Column:
    """Interleaved bits of each axis' rank in equal-width steps between its bounds."""
    if len(axes) * bits > 62:
        raise ValueError("too many bits")
    low_high = df.agg(*[f(a).cast("double") for a in axes for f in (F.min, F.max)]).first()
    steps = []
    for k, axis in enumerate(axes):
        low, high = low_high[2 * k] or 0.0, low_high[2 * k + 1] or 0.0
        scale = ((1 << bits) - 1) / (high - low) if high > low else 0.0
        steps.append(F.floor((F.coalesce(F.col(axis).cast("double"), F.lit(low)) - low) * scale).cast("long"))
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, step in enumerate(steps):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(step, b).bitwiseAND(F.lit(1)), b * len(axes) + k))
    return out


def z_clustered(df: DataFrame, axes: list[str], partitions: int) -> DataFrame:
    """Range-partitioned and sorted along a space-filling curve over several axes."""
    return df.withColumn("_z", z_order(df, axes)).repartitionByRange(partitions, "_z").sortWithinPartitions("_z").drop("_z")


@dataclass(frozen=True)
class Split:
    """A node of a median-split plan; leaves are numbered cells."""

    axis: str | None = None
    at: float | None = None
    low: Split | None = None
    high: Split | None = None
    cell: int = -1

    def lines(self, depth: int = 0) -> list[str]:
        """The plan as indented text, one node a line."""
        if self.axis is None:
            return [f"{'  ' * depth}cell {self.cell}"]
        return [f"{'  ' * depth}{self.axis} < {self.at}", *self.low.lines(depth + 1), *self.high.lines(depth + 1)]

    def cell_of(self) -> Column:
        if self.axis is None:
            return F.lit(self.cell)
        return F.when(F.col(self.axis) < F.lit(self.at), self.low.cell_of()).otherwise(self.high.cell_of())


def median_splits(df: DataFrame, axes: list[str], depth: int, accuracy: int = 1000, rule: str = "median") -> Split:
    """Cut space ``depth`` times, axes in turn, at medians (or ``midpoint``: half-way in the widest axis).

    One aggregation a depth finds the cuts of all its cells; cells number 2**depth.
    """
    if rule not in ("median", "midpoint"):
        raise ValueError(f"unknown rule {rule!r}")

    def measure(cell: Column) -> dict[int, tuple]:
        marks = [F.percentile_approx(a, 0.5, accuracy) for a in axes] + [F.min(a) for a in axes] + [F.max(a) for a in axes]
        return {r[0]: tuple(r)[1:] for r in df.groupBy(cell.alias("cell")).agg(*marks).collect()}

    def choose(level: int, found: tuple | None) -> tuple[str, float] | None:
        n = len(axes)
        if found is None or any(x is None for x in found):
            return None
        medians, lows, highs = found[:n], found[n : 2 * n], found[2 * n :]
        if rule == "midpoint":
            k = max(range(n), key=lambda i: highs[i] - lows[i])
            at = (lows[k] + highs[k]) / 2
        else:
            k = level % n
            at = medians[k]
        return None if lows[k] == highs[k] else (axes[k], at)

    cuts: dict[int, tuple[str, float]] = {}

    def tree(number: int, level: int, stop: int) -> Split:
        if level == stop or number not in cuts:
            return Split(cell=number)
        axis, at = cuts[number]
        return Split(axis, at, tree(2 * number, level + 1, stop), tree(2 * number + 1, level + 1, stop))

    for level in range(depth):
        found = measure(tree(1, 0, level).cell_of())
        for number in range(1 << level, 2 << level):
            cut = choose(level, found.get(number))
            if cut:
                cuts[number] = cut
    return tree(1, 0, depth)


def with_pivot_distance(df: DataFrame, vector: str, pivot: list[float], column: str = "pivot_distance", metric: str = "l2") -> DataFrame:
    """Adds the distance to a pivot, by which ``pivot_candidates`` skips rows."""
    return df.withColumn(column, metrics.vector(metric, F.col(vector), F.array(*[F.lit(float(x)) for x in pivot])))


def pivot_candidates(df: DataFrame, query_to_pivot: float, radius: float, column: str = "pivot_distance") -> DataFrame:
    """Rows that the triangle inequality leaves within ``radius`` of a query: a plain, pushable range."""
    return df.filter(F.col(column).between(query_to_pivot - radius, query_to_pivot + radius))


def farthest_pivot(df: DataFrame, vector: str, candidates: int = 10, seed: int = 0) -> list[float]:
    """Of a few sampled rows, the one whose distances to a sample spread most.

    The sample only chooses a pivot, which no result depends on.
    """
    rows = [r[0] for r in df.select(vector).orderBy(F.rand(seed)).limit(5 * candidates).collect()]
    if not rows:
        raise ValueError("no rows to choose a pivot from")

    def spread(pivot: list[float]) -> float:
        gaps = [sum((a - b) ** 2 for a, b in zip(pivot, r, strict=True)) ** 0.5 for r in rows]
        mean = sum(gaps) / len(gaps)
        return sum((g - mean) ** 2 for g in gaps)

    return list(max(rows[:candidates], key=spread))


def random_pivot(df: DataFrame, vector: str, seed: int = 0) -> list[float]:
    """Any row's vector, by chance."""
    rows = df.select(vector).orderBy(F.rand(seed)).limit(1).collect()
    if not rows:
        raise ValueError("no rows to choose a pivot from")
    return [float(x) for x in rows[0][0]]


#: Ways to choose a pivot, by name.
PIVOTS = {"random": random_pivot, "spread": farthest_pivot}
