"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if ours != theirs:
        a = [r for r in ours if r not in set(theirs)][:2]
        b = [r for r in theirs if r not in set(ours)][:2]
        return f"{len(ours)} and {len(theirs)} rows; only ours {a}; only SQL's {b}"
    return None
