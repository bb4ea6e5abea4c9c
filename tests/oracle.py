"""Comparing a query with its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with the scale's tables as views."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    """Rows with columns by name, sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql: str, sf_dir: str) -> tuple[list[tuple], list[tuple]]:
    """(ours, theirs) as sorted rows; column names must agree."""
    cur = connect(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    return rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
