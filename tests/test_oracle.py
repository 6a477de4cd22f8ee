"""Every named query against its DuckDB SQL on the smallest test data."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from flightperf.plans.oracle import all_sql
from flightperf.plans.queries import all_queries

from tests.paths import SF001

TABLES = ["lineitem"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(E.oracle_sql()[name])
    want = _rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want


def test_every_query_has_oracle():
    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(E.queries()) and set(all_sql()) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["carrier", "category_ord", "category", "value", "ratio"]
    assert df.count() > 0
