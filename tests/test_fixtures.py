import duckdb
import pytest

from foliant.queries import fixtures


@pytest.fixture(scope="module")
def con():
    with duckdb.connect() as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_rows_equal_their_literals(spark, con, name):
    query, sql = fixtures.QUERIES[name]
    found = query(spark, "")
    cursor = con.execute(sql)
    assert found.columns == [d[0] for d in cursor.description]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(cursor.fetchall(), key=str)
