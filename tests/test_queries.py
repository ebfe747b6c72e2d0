"""Every registered query runs; where it has SQL, both give the same columns, types and values."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connection

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toArrow()
    if name in ORACLE:
        assert compare(got, duck.sql(ORACLE[name]).to_arrow_table()) is None
    else:
        assert got.num_rows


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_check_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
