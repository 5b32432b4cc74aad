import pytest

from siltstone.queries import ORACLES, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
