"""Connected components over an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import cut


def _tidy(edges: DataFrame) -> DataFrame:
    """Edges as (a, b) with a > b, each once."""
    return (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.filter("b > a")
        .join(low, "a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        low.select("a", F.col("m").alias("b"))
    )


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the least node.

    Alternates large-star and small-star steps until the edge set is a set of
    stars. Every step is a grouped minimum and an equi-join, so a hub's
    neighbours are never held in one task. An empty table gives no rows.
    """
    stars = cut(_tidy(edges))
    before = _digest(stars)
    while before[0]:
        stars = cut(_tidy(_small_star(_tidy(_large_star(stars)))))
        now = _digest(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
