"""Run registered queries beside their SQL: ``python tests/compare.py [sf] [name...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return v + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(frame_rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in frame_rows), key=repr)


def differences(spark, con, name, fn, sf_dir, sql):
    df = fn(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(res.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return len(got), f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and not any(a in name for a in sys.argv[2:]):
            continue
        start = time.time()
        try:
            n, why = differences(spark, con, name, fn, sf_dir, sqls.get(name))
            verdict = "rows only" if why is None else (why or "ok")
        except Exception as e:  # report and go on
            n, verdict = -1, f"ERROR {type(e).__name__}: {str(e)[:700]}"
        failed += verdict not in ("ok", "rows only")
        print(f"{name:36s} {n:7d} {time.time() - start:6.1f}s {verdict}", flush=True)
    print("failed", failed)
