"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

    python scripts/check_oracle.py [sf_dir] [name-prefix ...]

Comparison: column names sorted, row count, and the multiset of rows
(doubles already rounded by the registry on both sides).
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ticketscope.plans.fixtures import TABLES  # noqa: E402
from ticketscope.plans.registry import all_queries  # noqa: E402
from ticketscope.session import get_spark  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows]


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs = all_queries()
    ok = bad = 0
    for name, q in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            sdf = q.spark(spark, sf)
            scols = sdf.columns
            srows = rows_of(scols, [tuple(r) for r in sdf.collect()])
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = q.oracle()
        if sql is None:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            ok += 1
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = rows_of(dcols, res.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:800]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        cs, cd = Counter(srows), Counter(drows)
        if cs != cd:
            print(f"FAIL {name}: rows spark={len(srows)} duck={len(drows)}")
            print("   spark-only:", list((cs - cd).elements())[:3])
            print("   duck-only: ", list((cd - cs).elements())[:3])
            bad += 1
            continue
        print(f"OK   {name}: {len(srows)} rows {ts:.1f}s")
        ok += 1
    print(f"== {ok} ok, {bad} failed")


if __name__ == "__main__":
    main()
