"""Compare registered queries with their SQL in DuckDB, as the gate does.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, con, name, fn, text):
    t = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    got = rows_of(cols, [tuple(r) for r in df.collect()])
    dt = time.time() - t
    if text is None:
        return len(got[1]) > 0, f"rows={len(got[1])} (no SQL) {dt:.1f}s"
    rel = con.sql(text)
    want = rows_of(rel.columns, rel.fetchall())
    if got == want:
        return len(got[1]) > 0, f"rows={len(got[1])} {dt:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    a, b = set(got[1]), set(want[1])
    return False, (
        f"rows {len(got[1])} vs {len(want[1])}; cols={got[0]}\n   spark only {sorted(a - b)[:3]}\n   sql only   {sorted(b - a)[:3]}"
    )


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .appName("oracle")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{a.sf}"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if a.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in a.names):
            continue
        try:
            ok, msg = compare(spark, sf_dir, con, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: " + " | ".join(x for x in str(e).splitlines() if "Exception" in x or "Error" in x or "[" in x)[:900]
        print("ok  " if ok else "FAIL", name, msg, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
