"""Prefix, sliding and range folds of an indexed array (idx long, val) under a monoid.

An array may have gaps; a missing index counts as the identity. Nothing here
orders all rows in one task: prefixes are scanned block by block, and range folds
meet precomputed dyadic-style blocks by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.monoids import Monoid

#: Rows that a block of a prefix scan holds at most, as a power of two.
BLOCK_BITS = 16
#: Each level's blocks hold this power of two of the blocks below.
RADIX_BITS = 4


def last_index(array: DataFrame) -> int:
    """Largest index, -1 for an empty array."""
    top = array.agg(F.max("idx")).first()[0]
    return -1 if top is None else top


def _scan(array: DataFrame, monoid: Monoid, top: int, bits: int) -> DataFrame:
    """``array`` with ``upto`` (inclusive) and ``before`` (exclusive) folds; null folds are empty."""
    block = F.shiftright("idx", bits)
    in_block = Window.partitionBy(block).orderBy("idx")
    local = array.select(
        "*",
        monoid.agg("val").over(in_block.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        monoid.agg("val").over(in_block.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
    )
    if top >> bits <= 0:
        return local
    totals = array.groupBy(block.alias("idx")).agg(monoid.agg("val").alias("val"))
    carry = _scan(totals, monoid, top >> bits, bits).select(F.col("idx").alias("block"), F.col("before").alias("carry"))
    joined = local.join(carry, F.shiftright(local.idx, bits) == carry.block)
    merged = lambda c: monoid.merge(F.col("carry"), F.col(c))
    return joined.select(*array.columns, merged("upto").alias("upto"), merged("before").alias("before"))


def prefix(array: DataFrame, monoid: Monoid, bits: int = BLOCK_BITS) -> DataFrame:
    """(idx, val, prefix): the fold of all values up to and with each index.

    Blocks of 2**bits indices are folded on their own, block totals are scanned the same
    way, and each block adds what came before it; no task sees more than 2**bits rows.
    """
    slim = array.select(F.col("idx").cast("long").alias("idx"), "val")
    scanned = _scan(slim, monoid, last_index(slim), bits)
    return scanned.select("idx", "val", monoid.or_identity(F.col("upto")).alias("prefix"))


def prefix_at(array: DataFrame, monoid: Monoid, index: int) -> DataFrame:
    """One row: the fold of all values up to and with ``index``."""
    return array.filter(F.col("idx") <= index).agg(monoid.folded("val").alias("fold"))


def range_fold(array: DataFrame, monoid: Monoid, start: int, stop: int, closed: bool = False, clip: bool = False, size: int | None = None) -> DataFrame:
    """One row: the fold of [start, stop), or [start, stop] if ``closed``.

    Unless ``clip``, bounds outside the array raise ValueError (``size`` saves the job
    that finds its end).
    """
    end = stop + 1 if closed else stop
    if not clip:
        n = last_index(array) + 1 if size is None else size
        if start < 0 or end > n:
            raise ValueError(f"[{start}, {end}) is outside [0, {n})")
    return array.filter((F.col("idx") >= start) & (F.col("idx") < end)).agg(monoid.folded("val").alias("fold"))


def ordered_fold(array: DataFrame, start: int, stop: int, merge, identity: Column, bits: int = BLOCK_BITS) -> DataFrame:
    """One row: a fold in index order of [start, stop), for associative merges that do not commute.

    Blocks of 2**bits indices are folded on their own and their folds in turn, so no task
    holds more values than a block has.
    """
    rows = array.filter((F.col("idx") >= start) & (F.col("idx") < stop)).select((F.col("idx").cast("long") - start).alias("idx"), "val")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "val"))), lambda s: s["val"])
    span = max(0, stop - start - 1)
    while span >> bits:
        rows = rows.groupBy(F.shiftright("idx", bits).alias("idx")).agg(F.aggregate(ordered, identity, merge).alias("val"))
        span >>= bits
    return rows.agg(F.aggregate(ordered, identity, merge).alias("fold"))


def sliding_fold(array: DataFrame, monoid: Monoid, length: int, bits: int = BLOCK_BITS) -> DataFrame:
    """(idx, val, fold): the fold of the ``length`` indices ending at each index.

    Rows are dealt by blocks of indices; each block also gets the ``length - 1`` indices
    before it, so blocks are folded independently.
    """
    if length <= 0:
        raise ValueError("length must be positive")
    slim = array.select(F.col("idx").cast("long").alias("idx"), "val")
    own = F.shiftright("idx", bits)
    later = F.shiftright(F.col("idx") + (length - 1), bits)
    dealt = slim.withColumn("block", F.explode(F.sequence(own, later)))
    window = Window.partitionBy("block").orderBy("idx").rangeBetween(-(length - 1), 0)
    folded = dealt.select("idx", "val", "block", monoid.agg("val").over(window).alias("fold"))
    return folded.filter(F.col("block") == own).select("idx", "val", monoid.or_identity(F.col("fold")).alias("fold"))


def levels(array: DataFrame, monoid: Monoid, radix_bits: int = 1, top: int | None = None) -> DataFrame:
    """(level, block, fold): blocks of 2**(radix_bits * level) indices, up to one block for all.

    Each level is folded from the one below, so the work shrinks geometrically.
    """
    top = last_index(array) if top is None else top
    here = array.select(F.lit(0).alias("level"), F.col("idx").cast("long").alias("block"), F.col("val").alias("fold"))
    out, level = here, 0
    while top > 0:
        top >>= radix_bits
        level += 1
        up = here.groupBy(F.shiftright("block", radix_bits).alias("block")).agg(monoid.agg("fold").alias("fold"))
        here = up.select(F.lit(level).alias("level"), "block", "fold")
        out = out.unionByName(here)
    return out


def cover(lo: Column, end: Column, height: int, radix_bits: int) -> Column:
    """array<struct<level,block>>: the least set of blocks that make up [lo, end)."""
    parts = []
    for level in range(height + 1):
        low_shift, up_shift = radix_bits * level, radix_bits * (level + 1)
        # whole blocks of this level in the range, less those inside whole blocks of the next
        first = F.shiftright(lo + ((1 << low_shift) - 1), low_shift)
        last = F.shiftright(end, low_shift)
        if level == height:
            inner_first = inner_last = last
        else:
            inner_first = F.shiftleft(F.shiftright(lo + ((1 << up_shift) - 1), up_shift), radix_bits)
            inner_last = F.shiftleft(F.shiftright(end, up_shift), radix_bits)
        whole = inner_first < inner_last
        left_end = F.when(whole, inner_first).otherwise(last)
        span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        blocks = F.concat(span(first, left_end), F.when(whole, span(inner_last, last)).otherwise(F.array().cast("array<bigint>")))
        parts.append(F.transform(blocks, _at_level(level)))
    return F.concat(*parts)


def tree_height(top: int, radix_bits: int) -> int:
    """Levels above the array's own until one block holds indices 0 to ``top``."""
    height = 0
    while top >> (radix_bits * height) > 0:
        height += 1
    return height


def batch_range_fold(array: DataFrame, queries: DataFrame, monoid: Monoid, closed: bool = False, radix_bits: int = RADIX_BITS) -> DataFrame:
    """``queries`` (qid, lo, hi) with ``fold``, for any commutative monoid.

    Each query is cut into at most 2 * 2**radix_bits blocks a level, which meet the
    array's block folds by an equi-join; parts are folded by query. Bounds are clipped
    to the array; an empty range gives the identity.
    """
    top = last_index(array)
    height = tree_height(top, radix_bits)
    end = F.col("hi") + 1 if closed else F.col("hi")
    clipped = queries.select("qid", F.greatest("lo", F.lit(0)).cast("long").alias("lo"), F.least(end, F.lit(top + 1)).cast("long").alias("end"))
    blocks = cover(F.col("lo"), F.col("end"), height, radix_bits)
    wanted = clipped.filter("lo < end").select("qid", F.explode(blocks).alias("p")).select("qid", "p.level", "p.block")
    parts = wanted.join(levels(array, monoid, radix_bits, top), ["level", "block"])
    folded = parts.groupBy("qid").agg(monoid.agg("fold").alias("fold"))
    return queries.join(folded, "qid", "left").withColumn("fold", monoid.or_identity(F.col("fold")))


def _at_level(level: int):
    return lambda b: F.struct(F.lit(level).alias("level"), b.alias("block"))


def batch_range_difference(array: DataFrame, queries: DataFrame, monoid: Monoid, closed: bool = False, radix_bits: int = RADIX_BITS) -> DataFrame:
    """``batch_range_fold`` for an invertible monoid: the prefix up to the end less that before the start.

    Only the prefixes that queries need are made up, from the array's block folds.
    """
    if monoid.inverse is None:
        raise ValueError(f"{monoid.name} has no inverse")
    top = last_index(array)
    end = F.col("hi") + 1 if closed else F.col("hi")
    ends = queries.select("*", F.least(end, F.lit(top + 1)).cast("long").alias("_end"), F.greatest("lo", F.lit(0)).cast("long").alias("_lo"))
    wanted = ends.select("_end").union(ends.select("_lo")).distinct().select(F.col("_end").alias("at")).filter((F.col("at") > 0) & (F.col("at") <= top + 1))
    blocks = cover(F.lit(0).cast("long"), F.col("at"), tree_height(top, radix_bits), radix_bits)
    pieces = wanted.select("at", F.explode(blocks).alias("p")).select("at", "p.level", "p.block")
    upto = pieces.join(levels(array, monoid, radix_bits, top), ["level", "block"]).groupBy("at").agg(monoid.agg("fold").alias("prefix"))
    right = upto.select(F.col("at").alias("_end"), F.col("prefix").alias("_right"))
    left = upto.select(F.col("at").alias("_lo"), F.col("prefix").alias("_left"))
    joined = ends.join(right, "_end", "left").join(left, "_lo", "left")
    fold = F.when(F.col("_lo") < F.col("_end"), monoid.inverse(F.col("_right"), F.col("_left")))
    return joined.withColumn("fold", monoid.or_identity(fold)).drop("_end", "_lo", "_right", "_left")
