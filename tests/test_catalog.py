"""Every query of the catalog beside its SQL."""

import pytest

from tests.compare import connect, difference
from tidemark.plans import shape_catalog as catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sf, con, name):
    assert difference(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
