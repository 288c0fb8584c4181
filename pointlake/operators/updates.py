"""Point, interval and versioned updates of an indexed array, as set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.monoids import SUM, Monoid
from pointlake.operators.rangeagg import RADIX_BITS, cover, last_index, prefix, tree_height


def assign(array: DataFrame, changes: DataFrame) -> DataFrame:
    """Values of ``changes`` (idx, val) replace the array's.

    Of several changes of one index that with the greatest (ver, val) wins; without a
    ``ver`` that with the greatest val, null being the least.
    """
    order = [c for c in ("ver", "val") if c in changes.columns]
    new = changes.groupBy("idx").agg(F.max(F.struct(*order)).alias("_new"))
    return array.join(new, "idx", "left").select("idx", F.when(F.col("_new").isNotNull(), F.col("_new.val")).otherwise(F.col("val")).alias("val"))


def combine(array: DataFrame, changes: DataFrame, monoid: Monoid) -> DataFrame:
    """a[idx] becomes the fold of its value and all its changes (idx, val)."""
    folded = changes.groupBy("idx").agg(monoid.agg("val").alias("_change"))
    value = F.when(F.col("_change").isNull(), F.col("val")).otherwise(monoid.merge(F.col("val"), F.col("_change")))
    return array.join(folded, "idx", "left").select("idx", value.alias("val"))


def interval_add(array: DataFrame, changes: DataFrame, closed: bool = True) -> DataFrame:
    """Add each ``delta`` of (lo, hi, delta) to all elements of its interval.

    The deltas become steps at their ends, whose running sum is joined back: two rows an
    interval, whatever its length.
    """
    end = F.col("hi") + 1 if closed else F.col("hi")
    usable = changes.select(F.greatest("lo", F.lit(0)).cast("long").alias("lo"), end.cast("long").alias("end"), "delta").filter("lo < end")
    steps = usable.select(F.col("lo").alias("idx"), F.col("delta").alias("step")).unionByName(
        usable.select(F.col("end").alias("idx"), (-F.col("delta")).alias("step"))
    )
    summed = steps.groupBy("idx").agg(F.sum("step").alias("step"))
    slim = array.select(F.col("idx").cast("long").alias("idx"), "val")
    stepped = slim.join(summed, "idx", "full")
    running = prefix(stepped.select("idx", F.coalesce("step", F.lit(0)).alias("val")), SUM).select("idx", F.col("prefix").alias("_delta"))
    return slim.join(running, "idx").select("idx", (F.col("val") + F.col("_delta")).alias("val"))


def interval_combine(array: DataFrame, changes: DataFrame, monoid: Monoid, closed: bool = True, radix_bits: int = RADIX_BITS) -> DataFrame:
    """a[i] becomes the fold of its value and all deltas (lo, hi, delta) that cover i.

    Deltas stay pending on the blocks that make up their interval; every element then
    looks up its blocks, one equi-join for each level in use. Levels of few blocks are
    broadcast, so that their few keys gather no rows.
    """
    top = last_index(array)
    height = tree_height(top, radix_bits)
    end = F.col("hi") + 1 if closed else F.col("hi")
    clipped = changes.select(F.greatest("lo", F.lit(0)).cast("long").alias("lo"), F.least(end, F.lit(top + 1)).cast("long").alias("end"), "delta")
    blocks = cover(F.col("lo"), F.col("end"), height, radix_bits)
    pending = (
        clipped.filter("lo < end")
        .select(F.explode(blocks).alias("p"), "delta")
        .groupBy("p.level", "p.block")
        .agg(monoid.agg("delta").alias("delta"))
    )
    out = array.select(F.col("idx").cast("long").alias("idx"), "val")
    for level in range(height + 1):
        here = pending.filter(F.col("level") == level).select(F.col("block").alias("_block"), F.col("delta").alias("_delta"))
        # the level's blocks are (top >> shift) + 1 at most
        here = F.broadcast(here) if (top >> (radix_bits * level)) < 100_000 else here
        hit = out.join(here, F.shiftright(F.col("idx"), radix_bits * level) == F.col("_block"), "left")
        value = F.when(F.col("_delta").isNull(), F.col("val")).otherwise(monoid.merge(F.col("val"), F.col("_delta")))
        out = hit.select("idx", value.alias("val"))
    return out


class VersionedArray:
    """An append-only log of combining updates; every version stays readable.

    Version 0 is the base array; update k makes version k. The log holds (ver, idx, val).
    """

    def __init__(self, base: DataFrame, monoid: Monoid, log: DataFrame | None = None, versions: int = 0):
        self.base, self.monoid, self.versions = base, monoid, versions
        empty = base.select(F.lit(0).cast("long").alias("ver"), F.col("idx").cast("long").alias("idx"), "val").limit(0)
        self.log = empty if log is None else log

    @classmethod
    def of_log(cls, base: DataFrame, monoid: Monoid, log: DataFrame) -> VersionedArray:
        """From a stored log of (ver, idx, val); runs a job to find the last version."""
        last = log.agg(F.max("ver")).first()[0] or 0
        return cls(base, monoid, log.select("ver", F.col("idx").cast("long").alias("idx"), "val"), last)

    def update(self, index: int, value) -> VersionedArray:
        """A new array with one more version; this one is unchanged."""
        kind = dict(self.base.dtypes)["val"]
        row = self.base.sparkSession.range(1).select(
            F.lit(self.versions + 1).cast("long").alias("ver"), F.lit(index).cast("long").alias("idx"), F.lit(value).cast(kind).alias("val")
        )
        return VersionedArray(self.base, self.monoid, self.log.unionByName(row), self.versions + 1)

    def _checked(self, version: int) -> int:
        if not 0 <= version <= self.versions:
            raise ValueError(f"version {version} of 0 to {self.versions}")
        return version

    def at(self, version: int) -> DataFrame:
        """(idx, val) of one version."""
        changes = self.log.filter(F.col("ver") <= self._checked(version))
        return combine(self.base, changes, self.monoid)

    def fold(self, version: int, lo: int, hi: int) -> DataFrame:
        """One row: the fold of [lo, hi] in a version, for a commutative monoid."""
        changes = self.log.filter(F.col("ver") <= self._checked(version)).select("idx", "val")
        rows = self.base.select(F.col("idx").cast("long").alias("idx"), "val").unionByName(changes)
        return rows.filter(F.col("idx").between(lo, hi)).agg(self.monoid.folded("val").alias("fold"))

    def folds(self, wanted: list[int], lo: int, hi: int) -> DataFrame:
        """(ver, fold) for several versions, reading base and log once."""
        marks = F.array(*[F.lit(self._checked(v)).cast("long") for v in wanted])
        rows = self.base.select(F.lit(0).cast("long").alias("ver"), F.col("idx").cast("long").alias("idx"), "val").unionByName(self.log)
        inside = rows.filter(F.col("idx").between(lo, hi)).groupBy("ver").agg(self.monoid.agg("val").alias("val"))
        seen = inside.select(F.explode(F.filter(marks, lambda m: m >= F.col("ver"))).alias("ver"), "val")
        got = seen.groupBy("ver").agg(self.monoid.agg("val").alias("fold"))
        every = self.base.sparkSession.range(1).select(F.explode(marks).alias("ver"))
        return every.join(got, "ver", "left").select("ver", self.monoid.or_identity(F.col("fold")).alias("fold"))


def merge_all(arrays: list[DataFrame], monoid: Monoid) -> DataFrame:
    """Element-wise fold of several arrays."""
    rows = reduce(DataFrame.unionByName, [a.select("idx", "val") for a in arrays])
    return rows.groupBy("idx").agg(monoid.agg("val").alias("val"))
