"""Run named queries in Spark and their SQL in DuckDB and compare all values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_cell(x)) for x in v) + "]"
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(name, spark, con, d, queries, sqls):
    """(ok, message, rows, seconds)"""
    start = time.time()
    df = queries[name](spark, d)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in sqls:
        return True, "rows only", len(got), took
    res = con.execute(sqls[name])
    want_names, want = _rows([c[0] for c in res.description], res.fetchall())
    if got_names != want_names:
        return False, f"columns {got_names} vs {want_names}", len(got), took
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return False, f"{len(got)} vs {len(want)} rows; spark-only {len(a)} {sorted(a)[:2]} sql-only {len(b)} {sorted(b)[:2]}", len(got), took
    return True, "equal", len(got), took


def main():
    from barloom.catalog import QUERIES, SQL
    from barloom.session import local_session
    d = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)]
    spark, con, bad = local_session(8), connect(d), 0
    for n in names:
        try:
            ok, msg, rows, took = compare(n, spark, con, d, QUERIES, SQL)
        except Exception as e:  # keep going: one broken query must not hide the others
            ok, msg, rows, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:28s} rows={rows:7d} {took:6.2f}s {msg if not ok or msg != 'equal' else ''}", flush=True)
    print(f"{len(names)} queries, {bad} failed")


if __name__ == "__main__":
    main()
