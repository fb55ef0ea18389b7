"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v if isinstance(v, bool) else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, db, name):
    got = registry.queries()[name](spark, sf)
    cur = db.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted(str([norm(r[cols.index(c)]) for c in order]) for r in cur.fetchall())
    assert sorted(str([norm(r[c]) for c in order]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
