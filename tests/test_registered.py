"""All registered queries against their SQL in DuckDB, on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from caselens.plans.standins import TABLES
from tools.check import rows_of

SF = pathlib.Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    with duckdb.connect() as con:
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(SF)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["question_id", "question", "prompt"]
