"""Run a registered query and its SQL oracle and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark, con, name: str, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"{name}: columns {sorted(frame.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    return f"{name}: {len(bad)} rows differ, {sorted(columns)} {bad[:3]}" if bad else None
