"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

usage: python tools/oracle_check.py [--sf DIR] [name-substring ...]

Compares column names, row counts and the order-insensitive multiset of
rows (columns sorted by name), like the round's correctness gate.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm_frame(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        out = []
        for v in rec:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
                out.append("<null>")
            elif hasattr(v, "isoformat"):
                out.append(v.isoformat())
            elif isinstance(v, float):
                out.append(repr(float(v)))
            else:
                out.append(repr(v.item() if hasattr(v, "item") else v))
        rows.append(tuple(out))
    return sorted(rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--partitions", default="8")
    ap.add_argument("--tz", default="UTC")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()

    from meterframe.session import build_session
    from meterframe.plans.registry import all_queries

    spark = build_session("local[8]", conf={"spark.sql.shuffle.partitions": a.partitions, "spark.driver.memory": "8g", "spark.sql.session.timeZone": a.tz})
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(a.sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs = all_queries()
    bad = 0
    for name, q in qs.items():
        if a.names and not any(s in name for s in a.names):
            continue
        t0 = time.time()
        try:
            sdf = q.spark(spark, a.sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = q.oracle()
        if sql is None:
            print(f"rows  {name}: {len(sdf)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            ddf = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        problems = []
        if sorted(sdf.columns) != sorted(ddf.columns):
            problems.append(f"columns {sorted(sdf.columns)} vs {sorted(ddf.columns)}")
        elif len(sdf) != len(ddf):
            problems.append(f"rows {len(sdf)} vs {len(ddf)}")
        else:
            a_rows, b_rows = norm_frame(sdf), norm_frame(ddf)
            if a_rows != b_rows:
                diff = [(x, y) for x, y in zip(a_rows, b_rows) if x != y][:3]
                problems.append(f"values differ, e.g. {diff} cols={sorted(sdf.columns)}")
        if not problems:
            dt_s = {c: str(sdf[c].dtype) for c in sdf.columns}
            dt_d = {c: str(ddf[c].dtype) for c in ddf.columns}
            diff = {c: (dt_s[c], dt_d[c]) for c in dt_s if dt_s[c] != dt_d.get(c)}
            if diff:
                print(f"dtype {name}: {diff}")
        if problems:
            bad += 1
            print(f"FAIL  {name}: {'; '.join(problems)}")
        else:
            print(f"ok    {name}: {len(sdf)} rows {ts:.2f}s")
    print(f"{bad} failing")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
