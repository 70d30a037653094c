import pytest
from oracle import compare, connection

from trackloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, con, name):
    compare(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows_and_reruns_agree(spark, sf, name):
    first = sorted(map(str, catalog.QUERIES[name](spark, sf).collect()))
    assert first
    assert first == sorted(map(str, catalog.QUERIES[name](spark, sf).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
