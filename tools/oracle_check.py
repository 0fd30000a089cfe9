"""Run registered queries on Spark and their SQL on DuckDB; compare rows, columns and values.

usage: python tools/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from shopflow.plans import registry  # noqa: E402
from shopflow.session import build_session  # noqa: E402
from shopflow.sources.tables import TABLES  # noqa: E402


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--plain-tz", default=None, help="use a plain session with this time zone")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    registry.load_all()
    if a.plain_tz:
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.sql.session.timeZone", a.plain_tz).getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session("oracle-check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = a.names or list(registry.QUERIES)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = registry.QUERIES[n](spark, a.sf)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {n}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = registry.ORACLES.get(n)
        if sql is None:
            print(f"ROWS  {n}: {len(s_rows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(sql)
            d_cols = [c[0] for c in cur.description]
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {n}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(s_cols) != sorted(d_cols):
            print(f"FAIL  {n}: columns spark={s_cols} duck={d_cols}")
            bad += 1
            continue
        hs, ls = digest(s_cols, s_rows)
        hd, ld = digest(d_cols, d_rows)
        if len(s_rows) != len(d_rows) or hs != hd:
            bad += 1
            print(f"FAIL  {n}: rows spark={len(s_rows)} duck={len(d_rows)}")
            only_s = sorted(set(ls) - set(ld))[:5]
            only_d = sorted(set(ld) - set(ls))[:5]
            print("   cols:", sorted(s_cols))
            print("   spark-only:", only_s)
            print("   duck-only: ", only_d)
        else:
            print(f"OK    {n}: {len(s_rows)} rows {ts:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
