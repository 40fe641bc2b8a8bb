"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.queries() if n.startswith("q_"))


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, small, oracle, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    if sql := entry.oracle_sql().get(name):
        found = oracle.sql(sql)
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert {r["bucket"] for r in entry.entry(spark).collect()} == {"av", "ar", "rl"}


def test_micro_batches(spark, small):
    row = entry.queries()["q_micro_batch"](spark, small).first()
    assert row["largest"] <= 16 and row["repeated"] == 0 and row["unfinished"] == 0


def test_every_sql_has_a_query():
    assert not entry.oracle_sql().keys() - entry.queries().keys()
