"""Compares a query with its DuckDB SQL on the driver's tables."""

import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    return repr(value)


def same(spark, query, sql):
    """Both results as sorted rows of text, with columns by name."""
    df = query(spark, str(DATA))
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = views().sql(sql)
    assert sorted(rel.columns) == names
    order = [list(rel.columns).index(n) for n in names]
    theirs = sorted(tuple(plain(r[k]) for k in order) for r in rel.fetchall())
    return ours, theirs
