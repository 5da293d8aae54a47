"""Run a named Spark query and its DuckDB oracle on the same tables and
compare row count, column names and order-insensitive values."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, exact: bool):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(v) if exact else f"{v:.9g}")
    if isinstance(v, bool):
        return (3, str(v))
    if isinstance(v, (int,)):
        return (2, repr(float(v)) if exact else f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return (4, v.isoformat())
    if isinstance(v, dt.date):
        return (5, v.isoformat())
    return (6, str(v))


def rows_of(cols, rows, exact):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i], exact) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out = {
        "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "spark_cols": sorted(s_cols), "oracle_cols": sorted(d_cols),
    }
    if out["columns_match"]:
        out["exact"] = rows_of(s_cols, s_rows, True) == rows_of(d_cols, d_rows, True)
        a, b = rows_of(s_cols, s_rows, False), rows_of(d_cols, d_rows, False)
        out["tolerant"] = a == b
        if not out["tolerant"]:
            diff_a = [x for x in a if x not in set(b)][:3]
            diff_b = [x for x in b if x not in set(a)][:3]
            out["sample_spark_only"] = diff_a
            out["sample_oracle_only"] = diff_b
    return out
