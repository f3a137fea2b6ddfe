"""Comparison of registered queries with their oracle SQL in DuckDB."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connection(sf_dir=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def same(spark, con, query, sql, sf_dir=DATA):
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(repr(tuple(None if x != x or x is None else x.item() if hasattr(x, "item") else x for x in r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)) for d in (got, want)]
    assert rows[0] == rows[1]
