"""Every query with SQL gives the same rows and column names as DuckDB on the smallest test data."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from rollcall.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.toArrow().to_pylist())
    res = duck.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in res.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    zone = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    want = Counter(tuple(plain(zone(r[i])) for i in at) for r in res.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
