"""Run registered queries on Spark and their oracle statements on DuckDB and compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of the values.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from linecraft import catalog  # noqa: E402
from linecraft.session import TABLES, get_session  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return norm(tuple(v))
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names:
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf)
        rows = [tuple(r) for r in df.collect()]
        ts = time.time() - t0
        cols = df.columns
        sql = catalog.ORACLE.get(name)
        if sql is None:
            print(f"{name:28s} rows={len(rows):8d} spark={ts:6.1f}s  (no oracle)")
            continue
        t0 = time.time()
        try:
            cur = con.execute(sql)
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} ORACLE ERROR {e}")
            bad += 1
            continue
        to = time.time() - t0
        ok = (sorted(cols) == sorted(ocols) and len(rows) == len(orows)
              and digest(cols, rows) == digest(ocols, orows))
        bad += not ok
        print(f"{name:28s} rows={len(rows):8d}/{len(orows):8d} spark={ts:6.1f}s duck={to:6.1f}s "
              f"{'OK' if ok else 'MISMATCH'} {'' if sorted(cols) == sorted(ocols) else (cols, ocols)}")
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
