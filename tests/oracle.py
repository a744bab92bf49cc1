"""Runs a catalog's queries against their SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connect(root):
    con = duckdb.connect()
    for p in glob.glob(f"{root}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(catalog, spark, root, names=None):
    con = connect(root)
    bad = {}
    for name, sql in catalog.sql.items():
        if names and name not in names:
            continue
        df = catalog.queries[name](spark, root)
        rel = con.sql(sql)
        if sorted(df.columns) != sorted(rel.columns):
            bad[name] = (df.columns, rel.columns)
        elif rows_of(df.columns, df.collect()) != rows_of(rel.columns, rel.fetchall()):
            bad[name] = "rows differ"
    return bad
