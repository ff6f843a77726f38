"""Each query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(repr([plain(x) for x in r]) for r in rows) == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
