"""Holding a query's rows against its SQL in DuckDB."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def value(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        return x
    if hasattr(x, "__float__"):
        return round(float(x), 5) + 0.0
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


def compared(df, sql, con):
    """None, or what differs."""
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    b = rows_of(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    kinds = {n.lower(): t for n, t in df.dtypes}
    other = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for n, t in kinds.items():
        o = next(v for k, v in other.items() if k.lower() == n)
        want = {"bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",), "int": ("INTEGER",)}.get(t, (o,))
        if o not in want:
            return f"type of {n}: {t} {o}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    for x, y in zip(a[1], b[1], strict=True):
        if x != y and any(u != w and not (isinstance(u, float) and isinstance(w, (float, int)) and abs(u - w) < 2e-5) for u, w in zip(x, y, strict=True)):
            return f"{x} {y}"
    return None
