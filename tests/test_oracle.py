"""Every registered query equals its DuckDB oracle on the sf0.001 tables (the driver uses sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from coldlake.plans import registry
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF_SMALL)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(got_cols) == sorted(want_cols)
    assert len(got) == len(want)
    assert _rows(got_cols, got) == _rows(want_cols, want)


def test_every_query_has_oracle_or_is_rows_only(spark):
    names = set(registry.queries())
    rows_only = names - set(SQL)
    assert rows_only <= {"A09_random_sample"}
    assert len(names) >= 165 and names <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_readings"] == 952
