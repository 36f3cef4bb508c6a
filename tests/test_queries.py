"""Registered queries against their SQL in DuckDB."""

import os

import __spark_entry__ as entry
import duckdb
import pytest
from sitepair.plans.oracle import oracle_sql
from sitepair.plans.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(cells, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([c[i] for i in at]) for c in cells)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)


def test_csv_texts_are_whole(spark):
    texts = {r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    values = {r.value for r in entry.queries()["csv_texts"](spark, SF).collect()}
    assert any("\n" in t for t in texts) and all(t in values or "=" + t in values or "-" + t in values for t in texts if t is not None)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(oracle_sql()) <= set(entry.queries())
