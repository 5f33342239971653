"""Every registered query against its check SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


def test_entry(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    rel = con.sql(sql)
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
