import pytest

from tracery.plans import catalog

from .compare import connection, difference

ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, con, name):
    assert difference(catalog.queries()[name](spark, sf), con, ORACLES[name]) is None
