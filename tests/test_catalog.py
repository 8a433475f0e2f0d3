"""Registered queries against their SQL on the smallest tables; the entry points' contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 0
    for c in cols:
        assert (got[c].to_numpy() == want[c].to_numpy()).all()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run_and_repeat(spark, name):
    a, b = (sorted(map(str, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b and a


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
