"""Comparison of a query with its SQL, row by row, whatever the order."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value) if isinstance(value, float) else str(value)


def same(df, relation):
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    mine = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    theirs = sorted(str([plain(r[i]) for i in at]) for r in relation.fetchall())
    assert mine == theirs
