"""Rows of a query and of its SQL, side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns: list[str], data: list) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """What differs, or nothing."""
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    cur = connect(sf_dir).execute(sql)
    names, theirs = [c[0] for c in cur.description], cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, ours), rows(names, theirs)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} and {len(b)} rows; only Spark {len(only_a)}: {only_a[:2]}; only SQL {len(only_b)}: {only_b[:2]}"
