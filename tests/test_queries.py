"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry_points
from billwright.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    sql = entry_points.oracle_sql()[name]
    same, message = compare(spark, con, entry_points.queries()[name], sql, SF_DIR)
    assert same, message


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    rows = entry_points.entry(spark)
    assert rows.count() > 0 and "company_id" in rows.columns
