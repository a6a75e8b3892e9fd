"""Side-by-side check of a query and its oracle SQL, as tests and the command line use it."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = glob.glob(f"{p}/*.parquet") or [p]
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet({files!r})")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(round(float(v), 6) + 0.0) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in data)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if rows and columns agree, else what differs."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    b = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if a != b:
        x, y = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only Spark {x}; only SQL {y}"
    return "" if a else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from corpusloom.session import local_session

    d = sys.argv[1]
    spark, con, q, s = local_session(4), connect(d), e.queries(), e.oracle_sql()
    for k in sys.argv[2:] or sorted(s):
        t = time.time()
        try:
            said = compare(spark, con, k, q[k], s[k], d)
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{k}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
