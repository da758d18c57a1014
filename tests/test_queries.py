"""Every query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratalex.plans import catalogue

D = "/root/testdata/sf0.001"
catalogue.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, D).toPandas()
    if name not in catalogue.SQL:
        assert len(got.columns)
        return
    want = duck.sql(catalogue.SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    frames = [x[names].astype(str).sort_values(names, ignore_index=True) for x in (got, want)]
    assert frames[0].equals(frames[1])


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
