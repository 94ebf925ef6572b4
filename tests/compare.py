"""Run registered queries next to their SQL counterparts and compare whole results.

    python tests/compare.py <data directory> [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cell(x):
    if x is None:
        return "∅"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "∅"
        return repr(round(x, 9) + 0.0) if x != int(x) else repr(int(x))
    if isinstance(x, (list, tuple)):
        return repr([_cell(v) for v in x])
    return str(x)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def run_spark(df):
    return rows_of(df.columns, df.collect())


def run_sql(con, sql):
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    return rows_of(names, rel.fetchall())


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(sf_dir, names):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), connect(sf_dir)
    bad = []
    for name in names or queries:
        t0 = time.time()
        try:
            cols, got = run_spark(queries[name](spark, sf_dir))
            t1 = time.time()
            if name not in oracles:
                print(f"{name:28s} rows={len(got):7d} {t1 - t0:6.1f}s  (no SQL)", flush=True)
                continue
            want_cols, want = run_sql(con, oracles[name])
            ok = cols == want_cols and got == want
            print(f"{name:28s} rows={len(got):7d} {t1 - t0:6.1f}s {time.time() - t1:6.1f}s {'ok' if ok else 'DIFFERENT'}", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", cols, want_cols, "rows", len(got), len(want))
                a, b = set(got), set(want)
                for r in sorted(a - b)[:3]:
                    print("   spark", r)
                for r in sorted(b - a)[:3]:
                    print("   sql  ", r)
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"{name:28s} FAILED {type(e).__name__}: {str(e).strip()[:400]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
