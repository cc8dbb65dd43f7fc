"""Every registered query of the evaluation against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quern.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 10) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert got == sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
