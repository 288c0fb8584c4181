import os

import pytest

from pointlake.plans import catalogue
from tests.oracle import connect, same_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, con, name):
    rows = same_rows(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])
    assert rows > 0


def test_distance_join_compares_all_rows(spark):
    part = [(r.p_partkey, r.p_size, r.p_retailprice) for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    near = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 2.05
    want = sorted((a[0], b[0]) for a in part for b in part if a[0] < b[0] and near(a, b))
    assert sorted((r.id, r.id_r) for r in catalogue.queries()["radius_join"](spark, SF).collect()) == want


def test_distance_join_takes_no_table_to_the_driver(spark):
    found = catalogue.queries()["radius_join"](spark, SF)
    assert found.count() > 0
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_updates_take_all_events(spark):
    events = {r.event_id: r for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    last = {}
    for i in sorted(events):
        last[events[i].user_id] = i
    got = {r.idx: r.val for r in catalogue.queries()["point_update_assign"](spark, SF).collect()}
    assert all(got[u] == round(events[i].value * 100) for u, i in last.items() if u in got)
    versions = [r.ver for r in catalogue.queries()["versioned_range_max"](spark, SF).collect()]
    assert sorted(versions) == [0, len(events) // 2, len(events)]
