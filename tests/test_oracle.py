"""Every registered query that has an SQL twin against it, on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    problems = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert [p for p in problems if p != "no rows"] == []


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["site_id", "layer", "n_objects", "n_facts"] and df.count() > 0
