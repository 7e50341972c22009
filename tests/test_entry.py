"""The entry module, and the registered queries against their SQL twins at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from streetloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame):
    plain = lambda x: "" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, db, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(db.execute(registry.ORACLE[name]).df())


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_other_queries_have_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["node", "dist"]
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
