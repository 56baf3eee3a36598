"""Runs a query in Spark and its SQL in DuckDB and compares rows, columns by name, rows in any order."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:10]
    return v


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    names = sorted(df.columns)
    spark_rows = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    got = [d[0] for d in cur.description]
    if sorted(got) != names:
        return [f"columns {names} and {sorted(got)}"]
    at = [got.index(n) for n in names]
    sql_rows = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if len(spark_rows) != len(sql_rows):
        return [f"{len(spark_rows)} and {len(sql_rows)} rows", repr(spark_rows[:2]), repr(sql_rows[:2])]
    return [f"{a} and {b}" for a, b in zip(spark_rows, sql_rows) if a != b][:3]
