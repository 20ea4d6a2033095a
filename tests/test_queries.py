"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, message = compare(name, spark, con, SF)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
