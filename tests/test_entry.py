import duckdb
import pyarrow.dataset as ds
import pytest

import __spark_entry__ as e
from evidara.plans import catalog, catalog_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    df = e.entry(spark)
    assert df.count() > 0 and df.columns[0] == "query_id"


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog_sql.SQL) <= set(catalog.QUERIES)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.register(t, ds.dataset(f"{small}/{t}.parquet").to_table())
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, small, con, name):
    got = catalog.QUERIES[name](spark, small)
    order = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    if name not in catalog_sql.SQL:
        assert rows
        return
    want = con.sql(catalog_sql.SQL[name])
    assert sorted(want.columns) == order
    index = [want.columns.index(c) for c in order]
    assert rows == sorted((tuple(r[i] for i in index) for r in want.fetchall()), key=repr)
