"""Every query with SQL next to it, at the smallest scale."""

import pytest

import __spark_entry__ as entry_points
from check_oracle import compare, open_oracle

ALL = sorted(set(entry_points.queries()) - set(entry_points.LLM_QUERIES))


@pytest.fixture(scope="module")
def oracle_db(sf):
    con = open_oracle(sf)
    yield con
    con.close()


@pytest.mark.parametrize("name", ALL)
def test_query_agrees_with_sql(spark, oracle_db, sf, name):
    assert compare(spark, oracle_db, name, sf) == ""


def test_every_query_has_sql():
    assert set(entry_points.oracle_sql()) - set(entry_points.LLM_QUERIES) == set(ALL)


def test_entry_is_the_coverage_report(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["state", "city", "documents", "labeled", "level"]
    assert df.count() > 0
