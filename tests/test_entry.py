"""The driver's contract: every query runs on the smallest tables and has the rows that its SQL gives."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from lexaline import queries


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.Q))
def test_query(spark, small, sql, name):
    df = contract.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name in contract.oracle_sql():
        want = sql.sql(contract.oracle_sql()[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert got or name in ("prefix_all", "fuzzy_d0")
