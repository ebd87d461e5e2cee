"""Every query with SQL gives the rows of its SQL; the others run."""

import pytest

import __spark_entry__ as entry

from .compare import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_query(spark, con, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).columns
        query(spark, SF).collect()
    else:
        assert differences(spark, con, SF, query, sql) == ""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
