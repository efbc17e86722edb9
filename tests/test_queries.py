"""Every registered query against its SQL: on the small tables, and on the same tables made skewed."""

import os

import __spark_entry__ as entry_point
import duckdb
import oracle_check
import pytest

from ionframe.plans import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")

# The library's own queries; those of the optional package are tested beside it.
SQL = {name: sql for name, sql in entry_point.oracle_sql().items() if name in queries.QUERIES}
QUERIES = {name: query for name, query in entry_point.queries().items() if name in queries.QUERIES}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """A third of the peaks in one spectrum, of the spectra in one run, and of the events with one user and type."""
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    change = {
        "lineitem": "* REPLACE (CASE WHEN n % 3 = 0 THEN 42 ELSE l_orderkey END AS l_orderkey,"
        " CASE WHEN n % 3 = 0 THEN CAST(n % 120 AS INTEGER) ELSE l_linenumber END AS l_linenumber)",
        "orders": "* REPLACE (CASE WHEN n % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)",
        "events": "* REPLACE (CASE WHEN n % 3 = 0 THEN 5 ELSE user_id END AS user_id,"
        " CASE WHEN n % 3 = 0 THEN 'click' ELSE event_type END AS event_type)",
    }
    for t in oracle_check.TABLES:
        columns = change.get(t, "*")
        con.execute(
            f"COPY (SELECT {columns.replace('* REPLACE', '* EXCLUDE (n) REPLACE') if t in change else '* EXCLUDE (n)'} "
            f"FROM (SELECT *, row_number() OVER () AS n FROM '{SMALL}/{t}.parquet')) TO '{folder}/{t}.parquet'"
        )
    return str(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert oracle_check.compare(spark, oracle_check.connect(SMALL), QUERIES[name], SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_skewed_tables(spark, skewed, name):
    assert oracle_check.compare(spark, oracle_check.connect(skewed), QUERIES[name], SQL[name], skewed) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
