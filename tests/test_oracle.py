"""Every named query against its SQL on the smallest tables."""

import os

import pytest

from barloom.catalog import QUERIES, SQL
from tests.compare import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, con):
    assert name in SQL
    ok, message, _, _ = compare(name, spark, con, SF, QUERIES, SQL)
    assert ok, message
