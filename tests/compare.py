"""Run registered queries next to their checker SQL.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def checker(sf_dir):
    import duckdb

    from feedloom.plans.adapters import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, name):
    """(ok, message)"""
    from feedloom.plans.catalog import CHECKS, QUERIES

    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in CHECKS:
        return True, f"{len(got)} rows, no checker, {took:.1f}s"
    cur = con.execute(CHECKS[name])
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    gc, g = table(df.columns, got)
    wc, w = table(want_cols, want)
    if gc != wc:
        return False, f"columns {gc} != {wc}"
    if g != w:
        a = [r for r in g if r not in set(w)][:3]
        b = [r for r in w if r not in set(g)][:3]
        return False, f"{len(g)} vs {len(w)} rows\n   spark {a}\n   sql   {b}"
    return True, f"{len(g)} rows, {took:.1f}s"


def main():
    from tests.session import local_session

    from feedloom.plans.catalog import QUERIES

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = local_session()
    con = checker(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, message = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, message, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
