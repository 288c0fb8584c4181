"""Exact nearest neighbours: one query, many queries, within a radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pointlake.functions import metrics


def _checked(k: int) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return k


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` and an observation whose ``seen`` is the number of rows that a search read."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("seen")), seen


def with_distance(df: DataFrame, query: dict[str, float], metric: metrics.Metric = "l2") -> DataFrame:
    a = [F.col(c) for c in query]
    return df.withColumn("distance", metrics.wide(metric, a, [F.lit(v) for v in query.values()]))


def knn(df: DataFrame, query: dict[str, float], k: int, id_col: str, metric: metrics.Metric = "l2", digits: int | None = None) -> DataFrame:
    """The k rows nearest to the query point, ascending; ties by id. Heap, no sort of all rows."""
    found = with_distance(df, query, metric)
    if digits is not None:
        found = found.withColumn("distance", F.round("distance", digits))
    return found.filter(F.col("distance").isNotNull()).orderBy("distance", id_col).limit(_checked(k))


def nearest(df: DataFrame, query: dict[str, float], id_col: str, metric: metrics.Metric = "l2") -> DataFrame:
    """One row, or none for an empty table."""
    return knn(df, query, 1, id_col, metric)


def knn_vector(df: DataFrame, vector: str, query: Column, k: int, id_col: str, metric: metrics.Metric = "l2", digits: int | None = None) -> DataFrame:
    """``knn`` on an array column."""
    distance = metrics.vector(metric, F.col(vector), query)
    if digits is not None:
        distance = F.round(distance, digits)
    return df.withColumn("distance", distance).filter(F.col("distance").isNotNull()).orderBy("distance", id_col).limit(_checked(k))


def _numpy_distances(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances (queries x rows), by differences, so that equal points have distance 0."""
    out = np.empty((len(queries), len(rows)))
    for i, q in enumerate(queries):
        gap = rows - q
        if metric == "l2":
            out[i] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        elif metric == "l1":
            out[i] = np.abs(gap).sum(1)
        elif metric == "linf":
            out[i] = np.abs(gap).max(1)
        else:
            p = float(metric.split(":")[1])
            out[i] = (np.abs(gap) ** p).sum(1) ** (1 / p)
    return out


class _Best:
    """The k nearest base rows of each query of a block, as base rows stream by."""

    def __init__(self, ids: list, vectors: list, k: int, metric: str, exclude_self: bool, digits: int):
        self.k, self.metric, self.exclude_self, self.digits = k, metric, exclude_self, digits
        self.kept: dict = {q: [] for q in ids}
        by_axes: dict[int, list[int]] = {}
        for at, v in enumerate(vectors):
            by_axes.setdefault(len(v), []).append(at)
        #: Queries by number of axes; rows of other lengths are no neighbours.
        self.groups = {n: ([ids[i] for i in which], np.array([vectors[i] for i in which])) for n, which in by_axes.items() if n}

    def see(self, row_ids: list, vectors: pa.ListArray) -> None:
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for n, (query_ids, wanted) in self.groups.items():
            own = np.nonzero(sizes == n)[0]
            if not len(own):
                continue
            rows = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), n)
            found = np.round(_numpy_distances(self.metric, rows, wanted), self.digits)
            for query, distances in zip(query_ids, found, strict=True):
                room = min(self.k + 1, len(distances))
                edge = np.partition(distances, room - 1)[room - 1]
                near = [(float(distances[j]), row_ids[own[j]]) for j in np.nonzero(distances <= edge)[0]]
                if self.exclude_self:
                    near = [x for x in near if x[1] != query]
                self.kept[query] = sorted(self.kept[query] + near)[: self.k]

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        flat = [(q, x[1], x[0]) for q, best in self.kept.items() for x in best]
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, kind, pa.float64()), strict=True)], names=["query_id", "id", "distance"])


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    id_col: str,
    vector: str,
    metric: metrics.Metric = "l2",
    exclude_self: bool = False,
    block_rows: int = 16_384,
    base_rows: int = 1_000_000,
    digits: int = 9,
) -> DataFrame:
    """(query_id, <id_col>, distance, rank): the k nearest base rows of every query.

    Up to ``block_rows`` queries are broadcast and ``base`` is read once. More are dealt to
    blocks of about that size, and base rows to parts of about ``base_rows``; each pair of a
    block and a part is a task's work of its own, so neither side reaches the driver. A task
    keeps its own best k for each query, and only those few rows are shuffled and ranked.
    Vectors that are null, or of other lengths than the query's, are no neighbours; query ids are
    distinct. An own metric is worked out by Spark on the same pairs of blocks and parts.
    """
    _checked(k)
    kind = base.schema[id_col].dataType.simpleString()
    slim = lambda df: df.select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("id is not null and v is not null")
    rows, wanted = slim(base), slim(queries)
    many = wanted.count()
    blocks = max(1, -(-many // block_rows))
    schema = f"query_id {kind}, id {kind}, distance double"
    if blocks == 1 and not callable(metric):
        held = wanted.collect()
        shared = base.sparkSession.sparkContext.broadcast(([r.id for r in held], [r.v for r in held]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(*shared.value, k, metric, exclude_self, digits)
            id_type = None
            for batch in batches:
                id_type = batch.schema.field(0).type
                best.see(batch.column(0).to_pylist(), batch.column(1))
            if id_type is not None:
                yield best.rows(id_type)

        found = rows.mapInArrow(run, schema)
    else:
        parts = max(1, -(-rows.count() // base_rows))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        part, block = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        asked = wanted.select(every(parts).alias("part"), block.alias("block"), F.lit(0).alias("side"), "id", "v")
        given = rows.select(part.alias("part"), every(blocks).alias("block"), F.lit(1).alias("side"), "id", "v")
        if callable(metric):
            left, right = asked.select("part", "block", F.col("id").alias("query_id"), F.col("v").alias("q")), given.select("part", "block", "id", "v")
            met = left.join(right, ["part", "block"]).filter(F.size("q") == F.size("v"))
            met = met.filter("query_id <> id") if exclude_self else met
            found = met.select("query_id", "id", F.round(metric(F.col("v"), F.col("q")), digits).alias("distance")).filter("distance is not null")
        else:

            def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                cell, ids, vectors, best, id_type = None, [], [], None, None
                for batch in batches:
                    id_type = batch.schema.field(3).type
                    keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
                    first = np.nonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))[0] if len(keys) else []
                    for start, stop in zip(first, [*first[1:], len(keys)], strict=True):
                        run = batch.slice(start, stop - start)
                        if tuple(keys[start, :2]) != cell:
                            if best:
                                yield best.rows(id_type)
                            cell, ids, vectors, best = tuple(keys[start, :2]), [], [], None
                        if keys[start, 2] == 0:
                            ids += run.column(3).to_pylist()
                            vectors += run.column(4).to_pylist()
                        elif ids:
                            best = best or _Best(ids, vectors, k, metric, exclude_self, digits)
                            best.see(run.column(3).to_pylist(), run.column(4))
                if best:
                    yield best.rows(id_type)

            dealt = asked.unionByName(given).repartition("part", "block").sortWithinPartitions("part", "block", "side")
            found = dealt.mapInArrow(cells, schema)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "distance", "rank")


def within_distance(left: DataFrame, right: DataFrame, axes: list[str], radius: float, metric: metrics.Metric = "l2") -> DataFrame:
    """Pairs of a left and a right row at most ``radius`` apart, with their distance.

    Left columns keep their names; right ones get the suffix ``_r``. Space is cut into
    cells of side ``radius`` on the first two axes; a right row goes to its own and the
    adjacent cells, so candidates meet by an equi-join. For an own metric, which must keep
    the triangle inequality, cells are cut along the distance to one left row instead.
    Both sides are shuffled and sorted: Spark guesses the right one's size from the table's,
    without its copies for adjacent cells, and would take it to the driver for a broadcast.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    columns = left.columns
    if callable(metric):
        pivot = left.select(*axes).dropna().limit(1).collect()
        at = [F.lit(float(x)) for x in pivot[0]] if pivot else [F.lit(0.0)] * len(axes)
        left, right = (side.withColumn("_pivot", metrics.wide(metric, [F.col(a) for a in axes], at)) for side in (left, right))
    cut = ["_pivot"] if callable(metric) else axes[:2]
    cell = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(radius))).cast("long")
    named = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    for n, axis in enumerate(cut):
        left = left.withColumn(f"_c{n}", cell(axis))
        named = named.withColumn(f"_d{n}", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(
            f"_d{n}", F.col(f"_d{n}") + cell(f"{axis}_r")
        )
    meet = [F.col(f"_c{n}") == F.col(f"_d{n}") for n in range(len(cut))]
    distance = metrics.wide(metric, [F.col(a) for a in axes], [F.col(f"{a}_r") for a in axes])
    joined = left.join(named.hint("merge"), meet).withColumn("distance", distance).filter(F.col("distance") <= radius)
    return joined.select(*columns, *[f"{c}_r" for c in right.columns if c != "_pivot"], "distance")
