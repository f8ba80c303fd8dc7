"""Every registered query against DuckDB over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from rasterdrill.plans.oracle import oracle_sql
from rasterdrill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(oracle_sql()[name]).df()
    assert len(got) > 0
    assert compare(got, want) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["poly_id", "time", "BS", "PV", "NPV", "Unobservable"]
    assert df.count() > 0
