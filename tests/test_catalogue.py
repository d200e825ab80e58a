"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if n.startswith("q"))

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches(spark, con, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    spark.catalog.clearCache()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: df[cols].astype(object).where(df[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True)
    assert key(got).equals(key(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
