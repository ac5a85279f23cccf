"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Compares row count, column names/types and an order-insensitive value hash.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from studiolake.plans.catalog import entries  # noqa: E402
from studiolake.session import get_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for e in entries():
        if names and e.name not in names:
            continue
        t0 = time.time()
        try:
            df = e.spark(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {e.name}: spark error {str(ex)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = e.oracle()
        if sql is None:
            print(f"rows-only {e.name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            res = con.execute(sql)
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {e.name}: duckdb error {str(ex)[:800]}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        ho, lo = digest(ocols, orows)
        ok = (len(srows) == len(orows)) and sorted(scols) == sorted(ocols) and hs == ho
        if ok:
            print(f"ok   {e.name}: {len(srows)} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"FAIL {e.name}: spark {len(srows)} rows vs oracle {len(orows)} rows; cols equal={sorted(scols)==sorted(ocols)}")
            so, oo = set(ls), set(lo)
            cols_sorted = sorted(scols)
            print("   cols:", "|".join(cols_sorted))
            for x in sorted(so - oo)[:4]:
                print("   spark only:", x[:400])
            for x in sorted(oo - so)[:4]:
                print("   oracle only:", x[:400])
    print("failures:", bad)


if __name__ == "__main__":
    main()
