"""The text queries beside their SQL, and the shape of every result."""

import pytest

from tests.compare import connect, difference
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_whole_table(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
