"""Runs registered queries against their SQL in DuckDB and compares whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(cell(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, cell(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return cell(x.asDict())
    return x


def close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-5 * max(1, abs(a))
    return a == b


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    mine, theirs = df.collect(), con.execute(sql).fetchall()
    names = [c[0] for c in con.description]
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(df.columns)
    key = lambda row: [(x is None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) if not isinstance(x, (int, float)) else (False, "", round(x, 3)) for x in row]
    a = sorted(([cell(r[c]) for c in order] for r in mine), key=key)
    b = sorted(([cell(r[names.index(c)]) for c in order] for r in theirs), key=key)
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    for x, y in zip(a, b, strict=False):
        if not all(map(close, x, y)):
            out.append(f"{order}: {x} and {y}")
            if len(out) > 2:
                break
    return out
