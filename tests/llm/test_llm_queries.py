"""The corpus queries that have SQL, against DuckDB."""

import duckdb
import pytest

from sparkloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = con.sql(registry.ORACLES[name])
    assert sorted(rows.columns) == columns
    at = [rows.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in rows.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want and want
