"""Registered queries against their SQL in DuckDB, at the smallest size."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quarrystone.queries import catalog, dialect


@pytest.fixture(scope="module")
def duck(request):
    con = duckdb.connect()
    for t in dialect.TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    found = duck.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(names) == columns
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == sorted(map(repr, want))


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
