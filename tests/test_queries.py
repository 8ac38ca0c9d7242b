"""Every registered query with SQL against DuckDB on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from sparkloom.plans import registry
from sparkloom.tables import TABLES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    have = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert have
        return
    rows = duck.sql(registry.ORACLES[name])
    assert sorted(rows.columns) == columns
    at = [rows.columns.index(c) for c in columns]
    assert have == sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=repr)
