"""Registered point and array queries, each with DuckDB SQL for the same rows.

Amounts are compared as integer cents and distances rounded, so that no result
depends on the order of floating-point additions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions import metrics, monoids
from pointlake.operators import bag, extrema, neighbors, ranges, rangeagg, updates
from pointlake.operators.model import Box, Interval, box_contains, box_disjoint, interval_contains, interval_disjoint
from pointlake.sources import layout
from pointlake.sources.tables import as_array, empty_points, random_array, random_points, read

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values in whole cents by event number."""
    cents = read(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return as_array(cents, "event_id", "cents")


_EV = "(SELECT event_id AS idx, CAST(round(value * 100) AS BIGINT) AS val FROM events)"

# ---- range search

@query("SELECT event_id, value FROM events WHERE value >= 10 AND value < 50")
def range_1d(spark, sf_dir):
    return ranges.range_search(read(spark, sf_dir, "events"), Box.of(value=(10, 50))).select("event_id", "value")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_size < 30 AND p_retailprice >= 905 AND p_retailprice < 960")
def range_2d(spark, sf_dir):
    found = ranges.range_search(read(spark, sf_dir, "part"), Box.of(p_size=(10, 30), p_retailprice=(905, 960)))
    return found.select("p_partkey", "p_size", "p_retailprice")


@query(
    "SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_shipdate FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 "
    "AND l_discount >= 0.03 AND l_discount < 0.06 AND l_shipdate >= timestamp '1995-01-01' AND l_shipdate < timestamp '1996-01-01'"
)
def range_3d(spark, sf_dir):
    import datetime as dt

    box = Box.of(l_quantity=(10, 20), l_discount=(0.03, 0.06), l_shipdate=(dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1)))
    found = ranges.range_search(read(spark, sf_dir, "lineitem"), box)
    return found.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_shipdate")


@query(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 40 AND l_discount >= 0.01 AND l_discount < 0.09 "
    "AND l_tax >= 0.01 AND l_tax < 0.07 AND l_extendedprice >= 2000 AND l_extendedprice < 60000 AND l_linenumber >= 2 AND l_linenumber < 6 AND l_suppkey >= 2 AND l_suppkey < 80"
)
def range_6d(spark, sf_dir):
    box = Box.of(l_quantity=(5, 40), l_discount=(0.01, 0.09), l_tax=(0.01, 0.07), l_extendedprice=(2000, 60000), l_linenumber=(2, 6), l_suppkey=(2, 80))
    return ranges.range_search(read(spark, sf_dir, "lineitem"), box).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT vec_id FROM embeddings WHERE embedding[1] >= -0.1 AND embedding[1] < 0.2 AND embedding[2] >= -0.15 AND embedding[2] < 0.1 AND embedding[3] >= 0 AND embedding[3] < 0.3")
def range_vector(spark, sf_dir):
    bounds = {0: Interval(-0.1, 0.2), 1: Interval(-0.15, 0.1), 2: Interval(0, 0.3)}
    return ranges.vector_range_search(read(spark, sf_dir, "embeddings"), "embedding", bounds).select("vec_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000")
def range_slice(spark, sf_dir):
    return ranges.slice_range(read(spark, sf_dir, "orders"), "o_totalprice", 100000).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= -500 AND c_acctbal < 0")
def range_negative(spark, sf_dir):
    return ranges.slice_range(read(spark, sf_dir, "customer"), "c_acctbal", -500, 0).select("c_custkey", "c_acctbal")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500 AND n_chars < 2000")
def range_documents(spark, sf_dir):
    return ranges.slice_range(read(spark, sf_dir, "documents"), "n_chars", 500, 2000).select("doc_id", "n_chars")


@query("SELECT min(p_retailprice) AS p_retailprice FROM part WHERE p_retailprice >= 931.5")
def range_lower_bound(spark, sf_dir):
    return ranges.lower_bound(read(spark, sf_dir, "part"), "p_retailprice", 931.5)


@query(
    "SELECT p_partkey, CAST(count(*) AS BIGINT) AS n FROM part JOIN lineitem ON l_extendedprice >= p_retailprice * 10 AND l_extendedprice < p_retailprice * 10 + p_size * 20 "
    "AND l_quantity >= p_size % 7 AND l_quantity < p_size WHERE p_partkey % 20 = 0 GROUP BY p_partkey"
)
def range_batch(spark, sf_dir):
    price = F.col("p_retailprice") * 10
    boxes = read(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(
        "p_partkey", price.alias("lo"), (price + F.col("p_size") * 20).alias("hi"), (F.col("p_size") % 7).alias("q_lo"), F.col("p_size").alias("q_hi")
    )
    points = read(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    found = ranges.batch_range_search(points, boxes, {"l_extendedprice": ("lo", "hi"), "l_quantity": ("q_lo", "q_hi")})
    return found.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = "(SELECT p_partkey AS id, p_size AS lo, p_size + p_partkey % 9 AS hi, p_retailprice AS lo2, p_retailprice + p_partkey % 5 AS hi2 FROM part)"


@query(
    f"""SELECT id, lo >= 10 AND hi < 20 AS inside, 10 > hi OR lo > 20 AS apart, lo >= 10 AND hi < 20 AND lo2 >= 920 AND hi2 < 950 AS box_inside,
    10 > hi OR lo > 20 OR 920 > hi2 OR lo2 > 950 AS box_apart FROM {_PAIRS}"""
)
def interval_algebra(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    lo, hi = F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 9
    lo2, hi2 = F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_partkey") % 5
    one, two = (F.lit(10), F.lit(20), lo, hi), (F.lit(920), F.lit(950), lo2, hi2)
    return part.select(
        F.col("p_partkey").alias("id"),
        interval_contains(*one).alias("inside"),
        interval_disjoint(*one).alias("apart"),
        box_contains([one, two]).alias("box_inside"),
        box_disjoint([one, two]).alias("box_apart"),
    )


# ---- nearest neighbours

_D2 = "round(sqrt((p_size - 25) * (p_size - 25) + (p_retailprice - 950) * (p_retailprice - 950)), 6)"


@query(f"SELECT p_partkey, {_D2} AS distance FROM part ORDER BY distance, p_partkey LIMIT 1")
def nearest_2d(spark, sf_dir):
    found = neighbors.knn(read(spark, sf_dir, "part"), {"p_size": 25, "p_retailprice": 950}, 1, "p_partkey", digits=6)
    return found.select("p_partkey", "distance")


@query(f"SELECT p_partkey, {_D2} AS distance FROM part ORDER BY distance, p_partkey LIMIT 10")
def knn_2d(spark, sf_dir):
    found = neighbors.knn(read(spark, sf_dir, "part"), {"p_size": 25, "p_retailprice": 950}, 10, "p_partkey", digits=6)
    return found.select("p_partkey", "distance")


def _knn_vector(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    base = read(spark, sf_dir, "embeddings")
    first = base.filter("vec_id = 0").select("embedding").first()
    query_vector = F.array(*[F.lit(float(x)) for x in first[0]])
    return neighbors.knn_vector(base, "embedding", query_vector, 10, "vec_id", metric, digits=6).select("vec_id", "distance")


def _vector_sql(term: str, whole: str) -> str:
    gap = "(z[1]::double - z[2]::double)"
    fold = f"list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: {term.format(gap=gap)}))"
    return f"SELECT e.vec_id, round({whole.format(fold=fold)}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, vec_id LIMIT 10"


@query(_vector_sql("{gap} * {gap}", "sqrt({fold})"))
def knn_vector(spark, sf_dir):
    return _knn_vector(spark, sf_dir, "l2")


@query(_vector_sql("abs({gap})", "{fold}"))
def knn_l1(spark, sf_dir):
    return _knn_vector(spark, sf_dir, "l1")


@query(_vector_sql("pow(abs({gap}), 3)", "pow({fold}, 1.0 / 3)"))
def knn_minkowski3(spark, sf_dir):
    return _knn_vector(spark, sf_dir, "minkowski:3")


@query(
    "SELECT e.vec_id, round(list_max(list_transform(list_zip(e.embedding, q.embedding), lambda z: abs(z[1]::double - z[2]::double))), 6) AS distance "
    "FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, vec_id LIMIT 10"
)
def knn_linf(spark, sf_dir):
    return _knn_vector(spark, sf_dir, "linf")


@query(
    """SELECT query_id, vec_id, distance, rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 6) AS distance,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 6), e.vec_id) AS INTEGER) AS rank
    FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5"""
)
def knn_join(spark, sf_dir):
    base = read(spark, sf_dir, "embeddings")
    return neighbors.knn_join(base.filter("vec_id % 20 = 0"), base, 5, "vec_id", "embedding", exclude_self=True, digits=6)


@query(
    """SELECT a.p_partkey AS id, b.p_partkey AS id_r, round(sqrt((a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice)), 6) AS distance
    FROM part a JOIN part b ON sqrt((a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice)) <= 2.05
    WHERE a.p_partkey < b.p_partkey"""
)
def radius_join(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    found = neighbors.within_distance(part, part, ["p_size", "p_retailprice"], 2.05).filter("id < id_r")
    return found.select("id", "id_r", F.round("distance", 6).alias("distance"))


@query(
    """WITH p AS (SELECT embedding FROM embeddings WHERE vec_id = 1), q AS (SELECT embedding FROM embeddings WHERE vec_id = 2)
    SELECT vec_id FROM embeddings e, q WHERE sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) <= 1.3"""
)
def radius_by_pivot(spark, sf_dir):
    base = read(spark, sf_dir, "embeddings")
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in base.filter("vec_id in (1, 2)").collect()}
    gap = sum((a - b) ** 2 for a, b in zip(vectors[1], vectors[2], strict=True)) ** 0.5
    near = layout.pivot_candidates(layout.with_pivot_distance(base, "embedding", vectors[1]), gap, 1.3 + 1e-9)
    target = F.array(*[F.lit(x) for x in vectors[2]])
    return near.filter(metrics.vector("l2", F.col("embedding"), target) <= 1.3).select("vec_id")


# ---- extrema and bags

@query(
    "SELECT min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice, "
    "min(l_shipdate) AS min_l_shipdate, max(l_shipdate) AS max_l_shipdate FROM lineitem"
)
def bounds(spark, sf_dir):
    return extrema.bounds(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_shipdate"])


@query("SELECT round(stddev_pop(l_quantity), 6) AS stddev_l_quantity, round(stddev_pop(l_discount), 6) AS stddev_l_discount FROM lineitem")
def axis_spread(spark, sf_dir):
    found = extrema.spread(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return found.select(*[F.round(c, 6).alias(c) for c in ("stddev_l_quantity", "stddev_l_discount")])


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 1")
def min_point(spark, sf_dir):
    return extrema.min_point(read(spark, sf_dir, "part"), "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def max_point(spark, sf_dir):
    return extrema.max_point(read(spark, sf_dir, "part"), "p_size", "p_partkey").select("p_partkey", "p_size")


@query(
    """WITH m AS (SELECT p_size AS v FROM part ORDER BY p_size, p_partkey LIMIT 1 OFFSET (SELECT (count(*) - 1) // 2 FROM part))
    SELECT CASE WHEN p_size < v THEN 'below' WHEN p_size = v THEN 'at' ELSE 'above' END AS side, CAST(count(*) AS BIGINT) AS n FROM part, m GROUP BY 1"""
)
def split_three_way(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    median = part.agg(F.expr("percentile_disc(0.5) within group (order by p_size)")).first()[0]
    sides = bag.split_three_ways(part, "p_size", median)
    tagged = [df.select(F.lit(name).alias("side")) for name, df in zip(("below", "at", "above"), sides, strict=True)]
    return tagged[0].union(tagged[1]).union(tagged[2]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def _part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", F.round("p_retailprice").cast("long").alias("price"))


_LINES = "SELECT CAST(l_quantity AS INTEGER), l_linenumber, l_suppkey FROM lineitem"


def _line_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All lines as points of three axes, and a point of each part to look for among them."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("x"), F.col("l_linenumber").alias("y"), F.col("l_suppkey").alias("z"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), (F.col("p_partkey") % 7 + 1).cast("int").alias("y"), (F.col("p_partkey") % 10).alias("z"))
    return lines, parts


@query(f"SELECT p_partkey AS id FROM part WHERE (p_size, CAST(p_partkey % 7 + 1 AS INTEGER), p_partkey % 10) IN ({_LINES})")
def contains_batch(spark, sf_dir):
    lines, parts = _line_points(spark, sf_dir)
    return bag.contained(lines, parts, ["x", "y", "z"]).select("id")


@query(f"SELECT p_partkey AS id FROM part WHERE (p_size, CAST(p_partkey % 7 + 1 AS INTEGER), p_partkey % 10) NOT IN ({_LINES})")
def missing_batch(spark, sf_dir):
    lines, parts = _line_points(spark, sf_dir)
    return bag.not_contained(lines, parts, ["x", "y", "z"]).select("id")


@query("SELECT EXISTS (SELECT 1 FROM part WHERE p_size = 7) AS has_seven, EXISTS (SELECT 1 FROM part WHERE p_size = -1) AS has_none")
def contains_point(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return spark.createDataFrame([(bag.contains(part, {"p_size": 7}), bag.contains(part, {"p_size": -1}))], "has_seven boolean, has_none boolean")


@query("SELECT p_size FROM part UNION ALL SELECT s_nationkey FROM supplier")
def insert(spark, sf_dir):
    return bag.insert(read(spark, sf_dir, "part").select("p_size"), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("p_size")))


@query("SELECT l_suppkey FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier")
def remove_one(spark, sf_dir):
    gone = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return bag.remove(read(spark, sf_dir, "lineitem").select("l_suppkey"), gone)


@query("SELECT count(*) AS n, count(*) > 0 AS any FROM part")
def size_and_truth(spark, sf_dir):
    return read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("any"))


@query("SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS min_x, CAST(NULL AS DOUBLE) AS max_x")
def empty_source(spark, sf_dir):
    none = empty_points(spark, ["x", "y"])
    return extrema.bounds(none, ["x"]).select(F.lit(none.count()).alias("n"), "min_x", "max_x")


@query("SELECT CAST(500 AS BIGINT) AS n, true AS inside, CAST(200 AS BIGINT) AS n_array")
def generated_points(spark, sf_dir):
    made = random_points(spark, 500, ["x", "y"], -3, 9, seed=5)
    inside = F.expr("bool_and(x between -3 and 8 and y between -3 and 8)")
    return made.agg(F.count(F.lit(1)).alias("n"), inside.alias("inside")).withColumn("n_array", F.lit(random_array(spark, 200, 0, 9).count()))


@query("SELECT p_size >= 25 AS large, min(p_retailprice) AS min_p_retailprice, max(p_retailprice) AS max_p_retailprice FROM part GROUP BY 1")
def region_bounds(spark, sf_dir):
    return extrema.bounds(read(spark, sf_dir, "part").withColumn("large", F.col("p_size") >= 25), ["p_retailprice"], by=["large"])


@query("SELECT p_retailprice AS median FROM part ORDER BY p_retailprice LIMIT 1 OFFSET (SELECT (count(*) - 1) // 2 FROM part)")
def exact_median(spark, sf_dir):
    return spark.createDataFrame([(extrema.median(read(spark, sf_dir, "part"), "p_retailprice", room=50),)], "median double")


@query("SELECT p_partkey, p_size >= 10 AND p_size < 30 AND p_retailprice >= 920 AND p_retailprice < 950 AS inside FROM part")
def point_in_box(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", ranges.box_predicate(part, Box.of(p_size=(10, 30), p_retailprice=(920, 950))).alias("inside"))


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN 'low' ELSE 'high' END AS side FROM part WHERE p_size >= 10 AND p_size < 30")
def box_split(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    low, high = Box.of(p_size=(10, 30), p_retailprice=(None, None)).split("p_size", 20)
    sides = [ranges.range_search(part, box).select("p_partkey", F.lit(side).alias("side")) for side, box in (("low", low), ("high", high))]
    return sides[0].unionByName(sides[1])


@query("SELECT p_partkey FROM part WHERE p_retailprice >= 905 AND p_retailprice < 960")
def box_suffix(spark, sf_dir):
    return ranges.range_search(read(spark, sf_dir, "part"), Box.of(p_size=(10, 30), p_retailprice=(905, 960)).suffix(1)).select("p_partkey")


@query("SELECT count(*) AS seen FROM part")
def rows_seen(spark, sf_dir):
    rows, seen = neighbors.counted(read(spark, sf_dir, "part"))
    neighbors.knn(rows, {"p_size": 25, "p_retailprice": 950}, 10, "p_partkey").collect()
    return spark.createDataFrame([(seen.get["seen"],)], "seen long")


@query("SELECT p_partkey, round(2 * abs(p_size - 25) + abs(p_retailprice - 950), 6) AS distance FROM part ORDER BY distance, p_partkey LIMIT 10")
def knn_own_metric(spark, sf_dir):
    weighed = lambda a, b: 2 * F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))) + F.abs(F.get(a, F.lit(1)) - F.get(b, F.lit(1)))
    found = neighbors.knn(read(spark, sf_dir, "part"), {"p_size": 25, "p_retailprice": 950}, 10, "p_partkey", weighed, digits=6)
    return found.select("p_partkey", "distance")


@query("SELECT event_id, event_id & -event_id AS low FROM events")
def lowest_bits(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", metrics.lowest_bit(F.col("event_id")).alias("low"))


@query("SELECT event_id, value FROM events WHERE value >= 10 AND value < 50")
def range_on_clusters(spark, sf_dir):
    return ranges.range_search(layout.clustered(read(spark, sf_dir, "events"), "value", 8), Box.of(value=(10, 50))).select("event_id", "value")


_HALVES = "SELECT quantile_disc(p_size, 0.5) AS m FROM part"


@query(f"SELECT p_partkey, CASE WHEN p_size < m THEN 2 ELSE 3 END AS cell FROM part, ({_HALVES})")
def median_cells(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", layout.median_splits(part, ["p_size"], 1, accuracy=1_000_000).cell_of().alias("cell"))


@query(f"SELECT unnest(['p_size < ' || m, '  cell 2', '  cell 3']) AS line FROM ({_HALVES})")
def split_dump(spark, sf_dir):
    lines = layout.median_splits(read(spark, sf_dir, "part"), ["p_size"], 1, accuracy=1_000_000).lines()
    return spark.createDataFrame([(line,) for line in lines], "line string")


def _near_two(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    base = read(spark, sf_dir, "embeddings")
    pivot = layout.PIVOTS[rule](base, "embedding")
    two = [float(x) for x in base.filter("vec_id = 2").first().embedding]
    gap = sum((a - b) ** 2 for a, b in zip(pivot, two, strict=True)) ** 0.5
    near = layout.pivot_candidates(layout.with_pivot_distance(base, "embedding", pivot), gap, 1.3 + 1e-6)
    return near.filter(metrics.vector("l2", F.col("embedding"), F.array(*map(F.lit, two))) <= 1.3).select("vec_id")


_NEAR_TWO = "SELECT vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q WHERE sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) <= 1.3"


@query(_NEAR_TWO)
def radius_by_random_pivot(spark, sf_dir):
    return _near_two(spark, sf_dir, "random")


@query(_NEAR_TWO)
def radius_by_spread_pivot(spark, sf_dir):
    return _near_two(spark, sf_dir, "spread")


# ---- folds

@query(f"SELECT idx, val, CAST(sum(val) OVER (ORDER BY idx) AS BIGINT) AS prefix FROM {_EV}")
def prefix_sum(spark, sf_dir):
    return rangeagg.prefix(_events(spark, sf_dir), monoids.SUM, bits=12)


@query(f"SELECT idx, val, max(val) OVER (ORDER BY idx) AS prefix FROM {_EV}")
def prefix_max(spark, sf_dir):
    return rangeagg.prefix(_events(spark, sf_dir), monoids.MAX, bits=12)


@query(f"SELECT max(val) AS fold FROM {_EV} WHERE idx <= 900")
def prefix_point(spark, sf_dir):
    return rangeagg.prefix_at(_events(spark, sf_dir), monoids.MAX, 900)


@query(f"SELECT CAST(sum(val) AS BIGINT) AS fold FROM {_EV} WHERE idx >= 100 AND idx < 900")
def range_fold(spark, sf_dir):
    return rangeagg.range_fold(_events(spark, sf_dir), monoids.SUM, 100, 900)


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 closed ranges whose ends follow from their number and the array's length."""
    n = rangeagg.last_index(_events(spark, sf_dir)) + 1
    q = spark.range(500).select(F.col("id").alias("qid"), ((F.col("id") * 7919) % n).alias("lo"))
    return q.withColumn("hi", F.least(F.col("lo") + (F.col("qid") * F.col("qid")) % F.lit(n // 3), F.lit(n - 1)))


_Q = """(SELECT qid, lo, least(lo + (qid * qid) % (n // 3), n - 1) AS hi FROM (SELECT CAST(q AS BIGINT) AS qid, (q * 7919) % n AS lo, n
    FROM range(500) t(q), (SELECT max(event_id) + 1 AS n FROM events)))"""


@query(f"SELECT qid, lo, hi, CAST(sum(val) AS BIGINT) AS fold FROM {_Q} JOIN {_EV} ON idx BETWEEN lo AND hi GROUP BY ALL")
def range_sum_batch(spark, sf_dir):
    folded = rangeagg.batch_range_difference(_events(spark, sf_dir), _ranges(spark, sf_dir), monoids.SUM, closed=True)
    return folded.select("qid", "lo", "hi", "fold")


@query(f"SELECT qid, lo, hi, max(val) AS fold FROM {_Q} JOIN {_EV} ON idx BETWEEN lo AND hi GROUP BY ALL")
def range_max_batch(spark, sf_dir):
    return rangeagg.batch_range_fold(_events(spark, sf_dir), _ranges(spark, sf_dir), monoids.MAX, closed=True)


@query(f"SELECT qid, lo, hi, bit_xor(val) AS fold FROM {_Q} JOIN {_EV} ON idx BETWEEN lo AND hi GROUP BY ALL")
def range_xor_batch(spark, sf_dir):
    return rangeagg.batch_range_fold(_events(spark, sf_dir), _ranges(spark, sf_dir), monoids.BIT_XOR, closed=True)


@query(f"SELECT idx, val, CAST(sum(val) OVER (ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS fold FROM {_EV}")
def sliding_sum(spark, sf_dir):
    return rangeagg.sliding_fold(_events(spark, sf_dir), monoids.SUM, 10, bits=12)


@query(f"SELECT idx, val, max(val) OVER (ORDER BY idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS fold FROM {_EV}")
def sliding_max(spark, sf_dir):
    return rangeagg.sliding_fold(_events(spark, sf_dir), monoids.MAX, 100, bits=12)


@query(
    f"SELECT CAST(sum(val) AS BIGINT) AS sum, min(val) AS min, max(val) AS max, bit_and(val) AS bit_and, bit_or(val) AS bit_or, bit_xor(val) AS bit_xor, "
    f"bool_and(val > 0) AS bool_and, bool_or(val > 0) AS bool_or FROM {_EV} WHERE idx BETWEEN 10 AND 400"
)
def monoid_folds(spark, sf_dir):
    inside = _events(spark, sf_dir).filter(F.col("idx").between(10, 400)).withColumn("flag", F.col("val") > 0)
    numbers = [monoids.ALL[m].folded("val").alias(m) for m in ("sum", "min", "max", "bit_and", "bit_or", "bit_xor")]
    return inside.agg(*numbers, *[monoids.ALL[m].folded("flag").alias(m) for m in ("bool_and", "bool_or")])


@query(
    f"SELECT l AS level, idx >> l AS block, max(val) AS fold FROM {_EV}, (SELECT CAST(x AS INTEGER) AS l FROM range(64) t(x)), (SELECT max(event_id) AS top FROM events) "
    "WHERE l = 0 OR (top >> (l - 1)) > 0 GROUP BY ALL"
)
def segment_levels(spark, sf_dir):
    return rangeagg.levels(_events(spark, sf_dir), monoids.MAX)


@query(
    f"SELECT string_agg(val % 10, '' ORDER BY idx) AS fold FROM {_EV} WHERE idx >= 20 AND idx < 60"
)
def ordered_fold(spark, sf_dir):
    digits = _events(spark, sf_dir).select("idx", (F.col("val") % 10).cast("string").alias("val"))
    return rangeagg.ordered_fold(digits, 20, 60, lambda acc, v: F.concat(acc, v), F.lit(""))


@query(f"SELECT product(val % 3 + 1) AS fold FROM {_EV} WHERE idx >= 10 AND idx < 30")
def product_fold(spark, sf_dir):
    small = _events(spark, sf_dir).select("idx", (F.col("val") % 3 + 1).alias("val"))
    return rangeagg.range_fold(small, monoids.PRODUCT, 10, 30)


# ---- updates

_CH = "(SELECT user_id AS idx, CAST(round(value * 100) AS BIGINT) AS val, event_id AS ver FROM events)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long").alias("val")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("idx"), cents, F.col("event_id").alias("ver"))


@query(f"SELECT a.idx, CAST(a.val + coalesce(c.val, 0) AS BIGINT) AS val FROM {_EV} a LEFT JOIN (SELECT idx, sum(val) AS val FROM {_CH} GROUP BY idx) c USING (idx)")
def point_update_combine(spark, sf_dir):
    return updates.combine(_events(spark, sf_dir), _changes(spark, sf_dir).select("idx", "val"), monoids.SUM)


@query(f"SELECT a.idx, coalesce(c.val, a.val) AS val FROM {_EV} a LEFT JOIN (SELECT idx, arg_max(val, ver) AS val FROM {_CH} GROUP BY idx) c USING (idx)")
def point_update_assign(spark, sf_dir):
    return updates.assign(_events(spark, sf_dir), _changes(spark, sf_dir))


_IV = f"(SELECT qid, lo, hi, qid % 11 * 100 AS delta FROM {_Q})"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).withColumn("delta", F.col("qid") % 11 * 100)


@query(f"SELECT a.idx, CAST(a.val + coalesce(sum(delta), 0) AS BIGINT) AS val FROM {_EV} a LEFT JOIN {_IV} i ON a.idx BETWEEN lo AND hi GROUP BY a.idx, a.val")
def interval_update_sum(spark, sf_dir):
    return updates.interval_add(_events(spark, sf_dir), _deltas(spark, sf_dir))


@query(f"SELECT a.idx, CAST(a.val + coalesce(sum(delta), 0) AS BIGINT) AS val FROM {_EV} a LEFT JOIN {_IV} i ON a.idx >= lo AND a.idx < hi GROUP BY a.idx, a.val")
def interval_update_half_open(spark, sf_dir):
    return updates.interval_combine(_events(spark, sf_dir), _deltas(spark, sf_dir), monoids.SUM, closed=False)


@query(f"SELECT a.idx, greatest(a.val, coalesce(max(delta), a.val)) AS val FROM {_EV} a LEFT JOIN {_IV} i ON a.idx BETWEEN lo AND hi GROUP BY a.idx, a.val")
def interval_update_max(spark, sf_dir):
    return updates.interval_combine(_events(spark, sf_dir), _deltas(spark, sf_dir), monoids.MAX)


@query(f"""WITH u AS (SELECT a.idx, a.val + coalesce(sum(delta), 0) AS val FROM {_EV} a LEFT JOIN {_IV} i ON a.idx BETWEEN lo AND hi GROUP BY a.idx, a.val)
    SELECT CAST(sum(val) AS BIGINT) AS fold FROM u WHERE idx BETWEEN 50 AND 700""")
def range_after_interval_update(spark, sf_dir):
    updated = updates.interval_add(_events(spark, sf_dir), _deltas(spark, sf_dir))
    return rangeagg.range_fold(updated, monoids.SUM, 50, 700, closed=True, clip=True)


_LOG = "(SELECT event_id + 1 AS ver, event_id * 13 % 1000 AS idx, CAST(round(value * 100) AS BIGINT) + 5000 AS val FROM events)"


@query(
    f"""SELECT CAST(t AS BIGINT) AS ver, max(val) AS fold FROM (SELECT unnest([0, n // 2, n]) AS t FROM (SELECT max(event_id) + 1 AS n FROM events)) JOIN
    (SELECT 0 AS ver, idx, val FROM {_EV} UNION ALL SELECT * FROM {_LOG}) l ON l.ver <= t WHERE idx BETWEEN 100 AND 160 GROUP BY t"""
)
def versioned_range_max(spark, sf_dir):
    """All events are the log, read at its start, middle and end."""
    log = read(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("ver"), (F.col("event_id") * 13 % 1000).alias("idx"), (F.round(F.col("value") * 100).cast("long") + 5000).alias("val")
    )
    n = rangeagg.last_index(_events(spark, sf_dir)) + 1
    return updates.VersionedArray.of_log(_events(spark, sf_dir), monoids.MAX, log).folds([0, n // 2, n], 100, 160)


@query(f"SELECT CAST(v AS BIGINT) AS ver, CAST(sum(val) AS BIGINT) + CASE v WHEN 0 THEN 0 WHEN 1 THEN 500 ELSE 420 END AS fold FROM {_EV}, (SELECT unnest([0, 1, 2]) AS v) WHERE idx BETWEEN 3 AND 90 GROUP BY v")
def versions_by_update(spark, sf_dir):
    return updates.VersionedArray(_events(spark, sf_dir), monoids.SUM).update(5, 500).update(7, -80).folds([0, 1, 2], 3, 90)


# ---- layout and change logs

@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_size < 30 AND p_retailprice >= 905 AND p_retailprice < 960")
def range_on_z_order(spark, sf_dir):
    part = layout.z_clustered(read(spark, sf_dir, "part"), ["p_size", "p_retailprice"], 8)
    found = ranges.range_search(part, Box.of(p_size=(10, 30), p_retailprice=(905, 960)))
    return found.select("p_partkey", "p_size", "p_retailprice")


@query(
    """WITH ops AS (SELECT p_size, 1 AS n FROM part UNION ALL SELECT s_nationkey, 1 FROM supplier UNION ALL SELECT c_nationkey, -1 FROM customer)
    SELECT p_size, CAST(sum(n) AS BIGINT) AS n FROM ops GROUP BY p_size HAVING sum(n) > 0"""
)
def bag_after_log(spark, sf_dir):
    from pointlake.streaming.changes import apply_log

    log = read(spark, sf_dir, "supplier").select(F.lit("insert").alias("op"), F.col("s_nationkey").alias("p_size"))
    log = log.unionByName(read(spark, sf_dir, "customer").select(F.lit("remove").alias("op"), F.col("c_nationkey").alias("p_size")))
    return apply_log(read(spark, sf_dir, "part"), log, ["p_size"]).groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
