"""Every registered query against its DuckDB statement on sf0.001 (the
driver's correctness gate runs the same comparison at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from facetlens.plans import catalog
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES
SQL = catalog.SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_is_registered_once():
    assert len(QUERIES) >= 90
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["token", "n", "weight"] and 0 < len(rows) <= 50
    assert rows[0].weight == 1.0
