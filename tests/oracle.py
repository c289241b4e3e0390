"""Run registered queries against their SQL in DuckDB: python tests/oracle.py [names or prefixes]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return repr(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a short text."""
    cols, rows = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want_cols, want = table(names, res.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}"
    if not rows:
        return "no rows"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"{len(bad)}/{len(rows)} differ, first {cols}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None


def main(argv):
    from pyspark.sql import SparkSession

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    con = connect(folder)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv or n in argv]
    failed = []
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, folder)
            msg = compare(df, con, sqls[n]) if n in sqls else (None if df.count() else "no rows")
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - t
        tag = "ok " if msg is None else "BAD"
        if msg or took > 5 or os.environ.get("VERBOSE"):
            print(f"{tag} {n} {took:.1f}s {'' if n in sqls else '(rows only)'} {msg or ''}", flush=True)
        if msg:
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
