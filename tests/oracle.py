"""Results side by side with DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6g}"
        return str(x)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def by_duckdb(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got = con.execute(sql)
    return rows_of([c[0] for c in got.description], got.fetchall())


def by_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
