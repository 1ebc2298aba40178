"""Holding a query against DuckDB's SQL on the same tables."""

import os

import duckdb


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = sorted(repr([dict(zip(columns, r, strict=True))[c] for c in order]) for r in found.fetchall())
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert got == expected
