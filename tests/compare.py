"""Run a query and its SQL twin side by side and compare their rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names: list[str], rows: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def differences(df, text: str, con: duckdb.DuckDBPyConnection) -> tuple[int, list[str], list[str]]:
    """(rows, only in Spark, only in SQL)."""
    got = con.execute(text)
    names = [d[0] for d in got.description]
    want = rows_of(names, got.fetchall())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    have = rows_of(df.columns, df.collect())
    from collections import Counter

    a, b = Counter(have), Counter(want)
    return len(have), list((a - b).elements()), list((b - a).elements())
