"""Runs registered queries next to their DuckDB SQL: python tests/compare.py [sf] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return f"f:{v + 0.0:.9g}"
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, name, folder):
    """None when equal, else a short text."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, folder)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} vs {want_cols}"
    if not got:
        return "both empty" if not want else "no rows in Spark"
    if got != want:
        a, b = set(got), set(want)
        return (f"rows {len(got)} vs {len(want)}; columns {cols}\n   only Spark: {sorted(a - b)[:3]}\n   only SQL:   {sorted(b - a)[:3]}")
    return None


if __name__ == "__main__":
    from colonnade.session import get_session
    import __spark_entry__ as e

    sf, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con, bad = get_session("8"), connect(folder), []
    spark.sparkContext.setLogLevel("ERROR")
    for name in e.queries():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, name, folder)
        except Exception as err:  # noqa: BLE001
            diff = f"{type(err).__name__}: {str(err)[:900]}"
        if diff:
            bad.append(name)
        kind = "sql" if name in e.oracle_sql() else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {name} {time.time() - start:.2f}s {diff or ''}", flush=True)
    print("bad:", bad)
