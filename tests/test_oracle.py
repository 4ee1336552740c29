"""Every registered query against its SQL on the driver's tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import FOLDER, compare, database

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return database()


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    assert compare(spark, connection, name, entry.queries()[name], SQL.get(name), FOLDER) is None


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["place", "mode", "n"] and df.count() == 13
