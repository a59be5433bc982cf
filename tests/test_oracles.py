import pytest
from conftest import SF
from oracle import compare, connect

from vaultlens.plans import registry


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_statement(spark, duck, name):
    rows = compare(registry.QUERIES[name](spark, SF), duck, registry.ORACLE[name])
    assert rows or name in ("pair_promotion",)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
