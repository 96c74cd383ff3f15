"""Spark results against DuckDB results of the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}") + 0.0
    if isinstance(x, int) and not isinstance(x, bool):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def bag(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sf_dir: str, sql: str) -> list[str]:
    """What differs between a Spark result and DuckDB's, if anything."""
    mine, (columns, theirs) = df.collect(), duck(sf_dir, sql)
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    a, b = bag(df.columns, mine), bag(columns, theirs)
    if a == b:
        return []
    only_a, only_b = [x for x in a if x not in set(b)] if len(a) < 20000 else [], [x for x in b if x not in set(a)] if len(b) < 20000 else []
    return [f"rows {len(a)} against {len(b)}", f"Spark only: {only_a[:3]}", f"DuckDB only: {only_b[:3]}"]
