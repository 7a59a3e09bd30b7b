"""Run registered queries in Spark and their SQL in DuckDB and compare values.

    python tests/compare.py [--sf 0.01] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

from tidemark.session import TABLE_NAMES


def spark_session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{root}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_result(spark, fn, root):
    df = fn(spark, root)
    return shape(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    cur = con.execute(sql)
    return shape([d[0] for d in cur.description], cur.fetchall())


def mismatch(a, b) -> str | None:
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} != {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if bad:
        return f"{len(bad)}/{len(a[1])} rows differ, first:\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--split", action="store_true", help="force the range-split plans")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    root = f"/root/testdata/sf{args.sf}"
    from tidemark.plans import ORACLES, QUERIES

    names = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    spark, con, failed = spark_session(), duck(root), []
    if args.split:
        spark.conf.set("spark.tidemark.maxGroupRows", "50")
        spark.conf.set("spark.tidemark.smallInputBytes", "0")
    for n in names:
        t0 = time.time()
        try:
            got = spark_result(spark, QUERIES[n], root)
            t1 = time.time()
            err = mismatch(got, duck_result(con, ORACLES[n])) if n in ORACLES else None
            tag = "ok" if n in ORACLES else "rows-only"
        except Exception as e:
            t1 = time.time()
            err = "".join(traceback.format_exception_only(e))[:1500]
            tag = ""
        if err:
            failed.append(n)
        print(f"{'FAIL' if err else tag:10s} {n:40s} {t1 - t0:6.2f}s rows={len(got[1]) if not err else '-'} {err or ''}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} passed; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
