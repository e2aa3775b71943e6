"""Queries against their SQL: columns by name, rows as multisets."""

from __future__ import annotations

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return float(round(x, 6))
    return str([plain(y) for y in x]) if isinstance(x, list | tuple) else x


def rows(columns: list[str], found) -> list[tuple]:
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> int:
    """Assert that both give the same rows; their number."""
    df = query(spark, sf_dir)
    got = df.collect()
    made = connect(sf_dir).execute(sql)
    names = [d[0] for d in made.description]
    assert sorted(df.columns) == sorted(names)
    want = made.fetchall()
    assert rows(df.columns, got) == rows(names, want)
    return len(got)
