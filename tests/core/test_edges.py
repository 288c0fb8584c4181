"""Definitions in plain Python against the operators, on seeded data with awkward cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pointlake.functions import metrics, monoids
from pointlake.operators import bag, extrema, neighbors, ranges, rangeagg, updates
from pointlake.operators.model import Box, Interval
from pointlake.sources import layout, tables

AXES = ["x", "y", "z"]


def cloud(seed=1, n=150):
    rng = random.Random(seed)
    rows = [tuple(rng.choice([rng.uniform(-20, 20), float(rng.randrange(-5, 5))]) for _ in AXES) for _ in range(n)]
    return rows + rows[:10] + [(0.0, 0.0, 0.0)] * 5


@pytest.fixture(scope="module")
def points(spark):
    return tables.points(spark, cloud(), AXES)


def coords(df):
    return sorted(tuple(r[a] for a in AXES) for r in df.collect())


@pytest.mark.parametrize("bounds", [((-5, 5), (-3.5, 9), (None, 4)), ((None, None), (0, None), (None, 0)), ((3, 3), (0, 9), (0, 9)), ((5, 1), (0, 9), (0, 9)), ((-100, 100),) * 3])
def test_box_is_half_open(points, bounds):
    box = Box.from_bounds(AXES, list(bounds))
    want = sorted(p for p in cloud() if p in box)
    assert coords(ranges.range_search(points, box)) == want


def test_maximum_is_outside_its_own_bound(points):
    top = max(p[0] for p in cloud())
    assert ranges.range_search(points, Box.of(x=(None, top))).count() == sum(p[0] < top for p in cloud())


def test_null_and_nan_are_never_inside(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, float("inf"))], "id int, x double")
    ids = lambda found: sorted(r.id for r in found.collect())
    assert ids(ranges.slice_range(df, "x", 0)) == [1, 4]
    assert ids(ranges.slice_range(df, "x", None, 5)) == [1]
    assert ids(ranges.slice_range(df, "x")) == [1, 4]
    assert ids(ranges.batch_range_search(df, spark.createDataFrame([(0.0, 5.0), (2.0, float("inf")), (9.0, 1.0), (None, 2.0)], "lo double, hi double"), {"x": ("lo", "hi")})) == [1]
    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(1, 0.0, nan), (2, nan, 5.0), (3, nan, nan), (4, -inf, -50.0), (5, -inf, inf), (6, 50.0, inf)], "q int, lo double, hi double")
    rows = spark.createDataFrame([(1, 1.0), (2, nan), (3, -inf), (4, inf), (5, 60.0), (6, None)], "id int, x double")
    found = ranges.batch_range_search(rows, odd, {"x": ("lo", "hi")})
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert sorted((r.q, r.id) for r in found.collect()) == [(4, 3), (5, 1), (5, 3), (5, 5), (6, 5)]
    whole = spark.createDataFrame([(1, 3)], "id int, y int")
    assert ranges.batch_range_search(whole, odd.withColumnsRenamed({"lo": "a", "hi": "b"}), {"y": ("a", "b")}).select("q").collect()[0].q == 5


def test_bad_boxes_and_slices(points):
    with pytest.raises(ValueError):
        ranges.range_search(points, Box.of(nothing=(0, 1)))
    with pytest.raises(ValueError):
        Box.from_bounds(AXES, [(0, 1)])
    with pytest.raises(ValueError):
        (1, 2) in Box.of(x=(0, 1))
    with pytest.raises(IndexError):
        ranges.slice_range(points, "x", 5, 1)
    with pytest.raises(TypeError):
        ranges.slice_range(points, "x", (1, 2))


def test_interval_and_box_algebra():
    a = Interval(0, 10)
    assert a.contains(Interval(0, 9)) and not a.contains(Interval(0, 10)) and not a.contains(Interval(-1, 5))
    assert not a.is_disjoint_from(Interval(10, 12)) and a.is_disjoint_from(Interval(11, 12)) and a.is_disjoint_from(Interval(-3, -1))
    assert Interval().contains(Interval()) and not Interval().is_disjoint_from(a) and Interval(3, 3).empty
    box = Box.of(x=(0, 10), y=(0, 4))
    assert box.contains(Box.of(x=(1, 2), y=(0, 3))) and box.is_disjoint_from(Box.of(x=(1, 2), y=(5, 6)))
    low, high = box.split("x", 3)
    assert low["x"] == Interval(0, 3) and high["x"] == Interval(3, 10) and high["y"] == box["y"]
    with pytest.raises(ValueError):
        box.split("x", 10)
    assert list(box.suffix(1)) == [Interval(0, 4)] and len(box) == 2
    with pytest.raises(ValueError):
        box.contains(Box.of(x=(0, 1)))


def test_batch_ranges_of_all_widths(spark, points):
    rng = random.Random(3)
    boxes = [(i, lo := rng.uniform(-25, 20), lo + rng.choice([0, 0.01, 1, 7, 300]), rng.uniform(-9, 0), 4.0) for i in range(60)]
    boxes += [(60, float("-inf"), 3.0, -1.0, 1.0), (61, float("-inf"), float("inf"), -1.0, 1.0)]
    table = spark.createDataFrame(boxes, "q int, a double, b double, c double, d double")
    got = ranges.batch_range_search(points, table, {"x": ("a", "b"), "y": ("c", "d")})
    want = sorted((q, *p) for q, a, b, c, d in boxes for p in cloud() if a <= p[0] < b and c <= p[1] < d)
    assert sorted((r.q, r.x, r.y, r.z) for r in got.collect()) == want


def distance(metric, p, q):
    gaps = [abs(a - b) for a, b in zip(p, q, strict=True)]
    return {"l2": math.dist(p, q), "l1": sum(gaps), "linf": max(gaps), "minkowski:3": sum(g**3 for g in gaps) ** (1 / 3)}[metric]


@pytest.mark.parametrize("metric", ["l2", "l1", "linf", "minkowski:3"])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_knn(points, metric, k):
    q = (0.5, -1.0, 2.0)
    got = neighbors.knn(points, dict(zip(AXES, q, strict=True)), k, "id", metric).collect()
    want = sorted((distance(metric, p, q), i) for i, p in enumerate(cloud()))[:k]
    assert [r.distance for r in got] == pytest.approx([d for d, _ in want])
    vectors = points.select("id", F.array(*AXES).alias("v"))
    same = neighbors.knn_vector(vectors, "v", F.array(*map(F.lit, q)), k, "id", metric).collect()
    assert [r.distance for r in same] == pytest.approx([d for d, _ in want])


def test_knn_ties_empty_and_bad_k(spark, points):
    at_zero = neighbors.knn(points, dict.fromkeys(AXES, 0.0), 3, "id").collect()
    zeros = [i for i, p in enumerate(cloud()) if p == (0.0, 0.0, 0.0)]
    assert [r.id for r in at_zero] == zeros[:3]
    assert neighbors.nearest(tables.empty_points(spark, AXES), dict.fromkeys(AXES, 0.0), "id").count() == 0
    for bad in (0, -1):
        with pytest.raises(ValueError):
            neighbors.knn(points, dict.fromkeys(AXES, 0.0), bad, "id")
    with pytest.raises(ValueError):
        metrics.wide("minkowski:0.5", [F.col("x")], [F.col("y")])


def test_rows_seen_by_a_search(points):
    rows, seen = neighbors.counted(points)
    assert neighbors.knn(rows, dict.fromkeys(AXES, 0.0), 3, "id").count() == 3 and seen.get["seen"] == len(cloud())


def test_own_metric(points):
    vectors = points.select("id", F.array(*AXES).alias("v"))
    first_axis = lambda a, b: F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0)))
    got = neighbors.knn_vector(vectors, "v", F.array(*map(F.lit, (1.0, 0.0, 0.0))), 5, "id", first_axis).collect()
    assert [r.distance for r in got] == pytest.approx(sorted(abs(p[0] - 1) for p in cloud())[:5])


def test_knn_join_blocks(points):
    vectors = points.select("id", F.array(*AXES).alias("v"))
    for block_rows in (1000, 7):
        got = neighbors.knn_join(vectors.filter("id % 5 = 0"), vectors, 4, "id", "v", block_rows=block_rows).collect()
        for q in range(0, 165, 5):
            want = sorted((round(math.dist(p, cloud()[q]), 9), i) for i, p in enumerate(cloud()))[:4]
            assert [(r.distance, r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    by_hand = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    own = neighbors.knn_join(vectors.filter("id % 5 = 0"), vectors, 4, "id", "v", metric=by_hand, block_rows=9, base_rows=50).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in own) == sorted((r.query_id, r.rank, r.id) for r in got)
    named = vectors.select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), "v")
    ragged = named.unionByName(named.limit(3).select(F.concat(F.lit("r"), "id").alias("id"), F.slice("v", 1, 2).alias("v")))
    for block_rows in (1000, 7):
        same = neighbors.knn_join(ragged, ragged, 2, "id", "v", block_rows=block_rows, base_rows=40, exclude_self=True).collect()
        assert len(same) == 2 * 165 + 2 * 3 and all(r.id.startswith("r") == r.query_id.startswith("r") and r.id != r.query_id for r in same)
    assert neighbors.knn_join(vectors.limit(0), vectors, 4, "id", "v").count() == 0
    assert neighbors.knn_join(vectors, vectors.limit(0), 4, "id", "v").count() == 0


def test_radius_join(points):
    got = neighbors.within_distance(points, points, AXES, 3.0).select("id", "id_r").collect()
    rows = cloud()
    want = sorted((i, j) for i in range(len(rows)) for j in range(len(rows)) if math.dist(rows[i], rows[j]) <= 3.0)
    assert sorted((r.id, r.id_r) for r in got) == want


def test_radius_join_of_an_own_metric(points):
    rows = cloud()
    city = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    got = neighbors.within_distance(points, points, AXES, 3.0, city).collect()
    want = sorted((i, j) for i in range(len(rows)) for j in range(len(rows)) if distance("l1", rows[i], rows[j]) <= 3.0)
    assert sorted((r.id, r.id_r) for r in got) == want


def test_exact_median(spark, points):
    rows = sorted(p[0] for p in cloud())
    for room in (5, 1000):
        assert extrema.median(points, "x", room) == rows[(len(rows) - 1) // 2]
    assert extrema.median(points.limit(0), "x") is None
    same = spark.range(5000).selectExpr("id % 3 as v")
    assert extrema.median(same, "v", 10) == 1


def test_ordered_folds_over_many_blocks(spark):
    letters = tables.array(spark, [chr(97 + k % 26) for k in range(200)], "string").repartition(6)
    whole = "".join(chr(97 + k % 26) for k in range(200))
    for start, stop in ((0, 200), (13, 154), (5, 5), (0, 1)):
        got = rangeagg.ordered_fold(letters, start, stop, lambda acc, v: F.concat(acc, v), F.lit(""), bits=3).first()[0]
        assert got == whole[start:stop]


def test_repeated_assignments_have_one_winner(spark):
    array = tables.array(spark, [1, 2, 3])
    ties = spark.createDataFrame([(0, 5, 1), (0, 7, 1), (1, 4, 2), (1, 9, 1)], "idx long, val long, ver long")
    assert sorted(map(tuple, updates.assign(array, ties).collect())) == [(0, 7), (1, 4), (2, 3)]
    assert sorted(map(tuple, updates.assign(array, ties.drop("ver")).collect())) == [(0, 7), (1, 9), (2, 3)]


def test_extrema_and_bag(spark, points):
    rows = cloud()
    b = extrema.bounds(points, AXES).first()
    assert (b.min_x, b.max_z) == (min(p[0] for p in rows), max(p[2] for p in rows))
    assert extrema.bounds(tables.empty_points(spark, AXES), AXES).first().min_x is None
    low = extrema.min_point(points, "y", "id").first()
    assert low.id == min(range(len(rows)), key=lambda i: (rows[i][1], i))
    assert extrema.max_value(points, "x") == max(p[0] for p in rows) and extrema.min_value(points, "x") == min(p[0] for p in rows)
    plain = points.select(*AXES)
    assert bag.contains(plain, {"x": 0.0, "y": 0.0, "z": 0.0}) and not bag.contains(plain, {"x": 0.0, "y": 0.0, "z": 77.0})
    one = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    zeros = lambda df: df.filter("x = 0 and y = 0 and z = 0").count()
    assert zeros(bag.remove_strict(plain, one)) == zeros(plain) - 1
    assert zeros(bag.insert(plain, one)) == zeros(plain) + 1
    with pytest.raises(ValueError):
        bag.remove_strict(plain, spark.createDataFrame([(0.0, 0.0, 99.0)], "x double, y double, z double"))
    emptied = bag.remove(plain, plain)
    assert emptied.count() == 0


ARRAY = [random.Random(9).randrange(-50, 50) for _ in range(300)]
PY = {"sum": sum, "min": lambda v: min(v, default=None), "max": lambda v: max(v, default=None)}


@pytest.fixture(scope="module")
def array(spark):
    return tables.array(spark, ARRAY).repartition(5)


@pytest.mark.parametrize("name", ["sum", "min", "max"])
def test_folds(spark, array, name):
    m, fold = monoids.ALL[name], PY[name]
    got = {r.idx: r.prefix for r in rangeagg.prefix(array, m, bits=3).collect()}
    assert got == {i: fold(ARRAY[: i + 1]) for i in range(300)}
    slid = {r.idx: r.fold for r in rangeagg.sliding_fold(array, m, 13, bits=4).collect()}
    assert slid == {i: fold(ARRAY[max(0, i - 12) : i + 1]) for i in range(300)}
    rng = random.Random(2)
    wanted = [(q, rng.randrange(-5, 305), rng.randrange(-5, 320)) for q in range(80)] + [(80, 0, 300), (81, 299, 300), (82, 5, 5)]
    queries = spark.createDataFrame(wanted, "qid long, lo long, hi long")
    clip = {q: fold(ARRAY[max(0, lo) : max(0, hi)]) if lo < hi else fold([]) for q, lo, hi in wanted}
    for radix in (1, 4):
        folded = rangeagg.batch_range_fold(array, queries, m, radix_bits=radix)
        assert {r.qid: r.fold for r in folded.collect()} == clip
    if m.inverse and name == "sum":
        assert {r.qid: r.fold for r in rangeagg.batch_range_difference(array, queries, m).collect()} == clip


def test_prefix_of_a_gappy_array(spark):
    idx = sorted(random.Random(4).sample(range(5000), 60))
    got = rangeagg.prefix(spark.createDataFrame([(i, i) for i in idx], "idx long, val long"), monoids.SUM, bits=2).collect()
    assert {r.idx: r.prefix for r in got} == {i: sum(j for j in idx if j <= i) for i in idx}
    assert rangeagg.prefix(spark.createDataFrame([], "idx long, val long"), monoids.SUM).count() == 0


def test_other_monoids(spark, array):
    small = array.filter("idx < 8").withColumn("val", F.abs("val") + 1)
    values = [abs(v) + 1 for v in ARRAY[:8]]
    one = lambda m, df=small: rangeagg.range_fold(df, monoids.ALL[m], 0, 8).first()[0]
    assert one("product") == pytest.approx(math.prod(values))
    flags = small.withColumn("val", F.col("val") > 10)
    assert one("bool_and", flags) == all(v > 10 for v in values) and one("bool_or", flags) == any(v > 10 for v in values)
    xor = 0
    for v in values:
        xor ^= v
    assert one("bit_xor") == xor
    assert rangeagg.range_fold(small, monoids.SUM, 3, 3).first()[0] == 0
    with pytest.raises(ValueError):
        rangeagg.range_fold(small, monoids.SUM, 0, 9)
    with pytest.raises(ValueError):
        rangeagg.range_fold(small, monoids.SUM, -1, 4)
    assert rangeagg.range_fold(small, monoids.SUM, -4, 99, clip=True).first()[0] == sum(values)


def test_updates(spark, array):
    rng = random.Random(6)
    changes = [(rng.randrange(300), rng.randrange(-9, 90), v) for v in range(120)]
    table = spark.createDataFrame(changes, "idx long, val long, ver long")
    summed, latest, highest = list(ARRAY), list(ARRAY), list(ARRAY)
    for i, v, _ in changes:
        summed[i] += v
        latest[i] = v
        highest[i] = max(highest[i], v)
    values = lambda df: [r.val for r in sorted(df.collect())]
    assert values(updates.combine(array, table, monoids.SUM)) == summed
    assert values(updates.combine(array, table, monoids.MAX)) == highest
    assert values(updates.assign(array, table)) == latest
    intervals = [(lo := rng.randrange(-3, 300), lo + rng.randrange(-2, 120), rng.randrange(-40, 60)) for _ in range(50)]
    deltas = spark.createDataFrame(intervals, "lo long, hi long, delta long")
    for closed in (True, False):
        added, raised = list(ARRAY), list(ARRAY)
        for lo, hi, d in intervals:
            for i in range(max(0, lo), min(300, hi + closed)):
                added[i] += d
                raised[i] = max(raised[i], d)
        assert values(updates.interval_add(array, deltas, closed)) == added
        assert values(updates.interval_combine(array, deltas, monoids.MAX, closed)) == raised
        assert values(updates.interval_combine(array, deltas, monoids.SUM, closed, radix_bits=1)) == added


def test_versions(spark, array):
    v0 = updates.VersionedArray(array, monoids.SUM)
    v1 = v0.update(5, 100)
    v2 = v1.update(7, -3).update(5, 1)
    base = sum(ARRAY[4:9])
    assert [v2.fold(v, 4, 8).first()[0] for v in range(4)] == [base, base + 100, base + 97, base + 98]
    assert v0.fold(0, 4, 8).first()[0] == base
    assert {r.ver: r.fold for r in v2.folds([0, 3], 4, 8).collect()} == {0: base, 3: base + 98}
    assert {r.idx: r.val for r in v2.at(1).collect()}[5] == ARRAY[5] + 100
    for bad in (-1, 4):
        with pytest.raises(ValueError):
            v2.fold(bad, 0, 1)


def test_layouts_keep_all_rows(spark, points):
    want = coords(points)
    assert coords(layout.clustered(points, "x", 4)) == want
    assert coords(layout.z_clustered(points, AXES, 4)) == want
    for rule in ("median", "midpoint"):
        plan = layout.median_splits(points, AXES, 3, rule=rule)
        cells = points.withColumn("cell", plan.cell_of())
        assert coords(cells) == want and 3 < cells.select("cell").distinct().count() <= 8
        assert len(plan.lines()) == 2 * sum("cell" in line for line in plan.lines()) - 1
    vectors = points.select("id", F.array(*AXES).alias("v"))
    pivot = layout.farthest_pivot(vectors, "v")
    marked = layout.with_pivot_distance(vectors, "v", pivot)
    q = [1.0, 2.0, 3.0]
    near = {r.id for r in layout.pivot_candidates(marked, math.dist(q, pivot), 5.0).collect()}
    assert {i for i, p in enumerate(cloud()) if math.dist(p, q) <= 5.0} <= near


def test_generators(spark):
    df = tables.random_points(spark, 500, ["a", "b"], -3, 4, seed=2)
    assert df.count() == 500 and df.filter("a < -3 or a > 3 or b < -3 or b > 3").count() == 0
    assert tables.random_array(spark, 10, 0, 5).columns == ["idx", "val"]
    with pytest.raises(ValueError):
        tables.points(spark, [(1.0,)], AXES)


def test_lowest_bit(spark):
    got = spark.range(1, 40).select("id", metrics.lowest_bit(F.col("id")).alias("low")).collect()
    assert all(r.low == r.id & -r.id for r in got)


def test_pushdown_reaches_the_scan(spark, points, tmp_path):
    layout.clustered(points, "x", 2).write.parquet(str(tmp_path / "p"))
    found = ranges.range_search(spark.read.parquet(str(tmp_path / "p")), Box.of(x=(0, 1))).select("x")
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(x,0" in plan and "LessThan(x,1" in plan and "ReadSchema: struct<x:double>" in plan


def test_change_stream(spark, tmp_path):
    from pointlake.streaming import changes

    schema = "op string, x long"
    spark.createDataFrame([("insert", 1), ("insert", 1), ("insert", 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: changes.write_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("remove", 1), ("remove", 9)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 5
    base = spark.createDataFrame([(5,)], "x long")
    assert sorted(r.x for r in changes.apply_log(base, log, ["x"]).collect()) == [1, 2, 5]
