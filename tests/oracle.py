"""Compares a query with its SQL twin in DuckDB: column names, row counts and values in any order."""

from __future__ import annotations

import os

import duckdb

from scriptorium.tables import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return str(value)
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, query, sql: str, folder: str = DATA) -> None:
    frame = query(spark, folder)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    answer = connect(folder).execute(sql)
    want = rows([d[0] for d in answer.description], answer.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for g, w in zip(got[1], want[1], strict=True):
        assert g == w, (g, w)
