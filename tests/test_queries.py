"""Every registered query against its SQL, on the smallest tables."""

import pytest

from oracle import connect, duck_rows, spark_rows
from tessera import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, duck, name):
    got = spark_rows(queries.QUERIES[name](spark, FOLDER))
    if name in queries.ORACLE_SQL:
        assert got == duck_rows(duck, queries.ORACLE_SQL[name])
    else:
        assert got
