"""Run a query in Spark and its SQL in DuckDB, and compare rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def duck(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def differences(df: DataFrame, sql: str, sf_dir: str) -> list[str]:
    names, expected = duck(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(names, expected)
    if len(got) != len(want):
        return [f"{len(got)} and {len(want)} rows"]
    return [f"{a} and {b}" for a, b in zip(got, want, strict=True) if a != b][:5]
