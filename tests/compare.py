"""Runs a query on Spark and its SQL twin on DuckDB and compares rows, columns and values exactly.

As a script: ``python tests/compare.py [--sf DIR] [name-prefix ...]``.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", v + 0.0)
    if isinstance(v, dt.datetime):
        return ("t", v.isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(cell(x) for x in v))
    return (type(v).__name__, str(v))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, q, sf_dir):
    t0 = time.time()
    df = q.run(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    snames, s = canonical(df.columns, srows)
    if q.sql is None:
        return True, f"rows={len(s)} (rows only)", t1 - t0
    cur = con.execute(q.sql)
    dnames, d = canonical([c[0] for c in cur.description], cur.fetchall())
    if snames != dnames:
        return False, f"columns differ: spark={snames} sql={dnames}", t1 - t0
    if s == d:
        return True, f"rows={len(s)}", t1 - t0
    msg = f"rows spark={len(s)} sql={len(d)}"
    ss, ds = set(s), set(d)
    only_s = [r for r in s if r not in ds][:2]
    only_d = [r for r in d if r not in ss][:2]
    msg += f"\n   columns {snames}\n   spark only ({len(ss - ds)}) {only_s}\n   sql only ({len(ds - ss)}) {only_d}"
    return False, msg[:3000], t1 - t0


def main(argv):
    import __spark_entry__ as entry
    from respondex.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    entry.queries()
    from respondex.plans.catalog import CATALOG

    spark = local_session("compare")
    con = duck(sf)
    bad = 0
    for name in sorted(CATALOG):
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            ok, msg, sec = compare(spark, con, CATALOG[name], sf)
        except Exception as exc:  # report and go on with the next query
            ok, msg, sec = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {sec:.1f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
