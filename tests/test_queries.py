"""Every registered query at the smallest scale, beside its SQL."""

import pytest
from oracle import compare, connect

from pageloom.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    assert name in SQL
    assert compare(spark, connection, FOLDER, QUERIES[name], SQL[name]) is None


def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    frame = entry(spark)
    assert frame.columns == ["value"]
    assert frame.count() > 0
