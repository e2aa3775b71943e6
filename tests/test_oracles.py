import pytest

from cartulary.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
