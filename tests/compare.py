"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            at = f"{sf_dir}/{name}.parquet"
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/*.parquet')" if Path(at).is_dir() else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows(names: list[str], found: list) -> list[tuple]:
    by = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in by) for r in found), key=repr)


def near(a: object, b: object) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(near, a, b))
    return a == b


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs between the rows of ``df`` and those of ``sql``; empty if nothing does."""
    cur = connection(sf_dir).execute(sql)
    names = [x[0] for x in cur.description]
    want = rows(names, cur.fetchall())
    got = rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    if len(want) != len(got):
        return [f"{len(got)} rows and {len(want)}"]
    return [f"{a} and {b}" for a, b in zip(got, want, strict=True) if not near(a, b)][:3]
