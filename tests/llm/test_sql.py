"""Queries of the training-data operators against their SQL in DuckDB, at the smallest size."""

import duckdb
import pytest

from quarrystone.llm import registry


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
