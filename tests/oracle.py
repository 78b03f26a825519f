"""Run a query and its SQL side by side and compare the rows, whatever their order."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        if os.path.exists(at):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({[at] if os.path.isfile(at) else glob.glob(at + '/*.parquet')})")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, f, sql: str, sf_dir: str, con=None) -> list[str]:
    """What differs between the query's rows and the SQL's; empty if nothing does."""
    con = con or duck(sf_dir)
    df = f(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows and {len(want)}"]
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return [f"{a} and {b}" for a, b in bad[:3]]
