"""Every query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from spanforge.plans import catalog


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert got
    if name not in catalog.ORACLE_SQL:
        return
    for f in os.listdir(sf):
        duckdb.sql(f"CREATE OR REPLACE VIEW {f.removesuffix('.parquet')} AS FROM '{sf}/{f}'")
    relation = duckdb.sql(catalog.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = [tuple(plain(row[i]) for i in at) for row in relation.fetchall()]
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 3
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
