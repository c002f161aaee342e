"""Run registered queries on Spark and their SQL twins on DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name-substring ...]

Comparison: row count, column names, and the multiset of rows with floats
printed to 9 significant digits (order-insensitive).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillpoint.plans.catalog import load_all  # noqa: E402
from tillpoint.session import build_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        if v == 0:
            return "0"
        return f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}"
    if hasattr(v, "isoformat"):
        if isinstance(v, dt.datetime):
            return v.strftime("%Y-%m-%d %H:%M:%S.%f")
        return v.isoformat()
    if hasattr(v, "as_tuple"):  # Decimal
        return f"{float(v):.9g}"
    return str(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records), sorted(cols)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillpoint-check-"))
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    reg = load_all()
    ok = bad = 0
    for name, q in reg.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"ROWS {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            ok += 1
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        a, ac = rows_of(scols, srows)
        b, bc = rows_of(dcols, drows)
        if ac != bc:
            print(f"FAIL {name}: columns differ\n  spark  {ac}\n  duckdb {bc}")
            bad += 1
        elif len(a) != len(b):
            print(f"FAIL {name}: rows spark={len(a)} duckdb={len(b)}")
            bad += 1
        elif a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: values differ ({len(a)} rows); first diffs:")
            for x, y in diff:
                print("   spark ", x)
                print("   duckdb", y)
            print("   cols  ", ac)
            bad += 1
        else:
            print(f"PASS {name}: {len(a)} rows ({ts:.1f}s)")
            ok += 1
    print(f"== {ok} ok, {bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
