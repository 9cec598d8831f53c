"""Compares a query's rows with its SQL on DuckDB, values and column names alike."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, (bytearray, memoryview)):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, decimal.Decimal):
        return float(x) if x != x.to_integral_value() else int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def kinds(description):
    return {n: ("number" if t in ("NUMBER",) else str(t)) for n, t, *_ in description}


def duck(sql, folder, frames=None):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    for name, frame in (frames or {}).items():
        con.execute(f"DROP VIEW IF EXISTS {name}")
        con.register(name, frame)
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return canonical(columns, got.fetchall())


def spark_rows(df):
    return canonical(df.columns, df.collect())


def differences(df, sql, folder, frames=None, show=4):
    """None if equal, else what differs."""
    (a, x), (b, y) = spark_rows(df), duck(sql, folder, frames)
    if a != b:
        return f"columns: {a} and {b}"
    if len(x) != len(y):
        return f"rows: {len(x)} and {len(y)}; first {x[:2]} and {y[:2]}"
    bad = [(p, q) for p, q in zip(x, y) if repr(p) != repr(q)]
    return f"{len(bad)} of {len(x)} rows over {a}: {bad[:show]}" if bad else None
