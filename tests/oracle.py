"""Spark queries held against DuckDB on the same tables."""

from __future__ import annotations

import os
from functools import cache

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@cache
def connection():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def same(df, sql: str) -> None:
    cur = connection().execute(sql)
    theirs = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(theirs)
    mine = [tuple(r) for r in df.collect()]
    assert rows(df.columns, mine) == rows(theirs, cur.fetchall())
