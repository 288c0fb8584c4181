import pytest

from pointlake.llm import registry
from tests.oracle import connect, same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert same_rows(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) > 0


def test_every_operator_is_registered_once():
    numbers = [int(name[2:].split("_")[0]) for name in registry.queries()]
    assert sorted(numbers) == list(range(1, 11))
