"""Compare registered queries with their SQL: python -m tests.oracle [folder] [name-prefix ...]"""

import glob
import math
import os
import sys
import time

import duckdb


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if isinstance(v, float):
        return f"f{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, con, fn, sql, folder):
    """Returns (rows, problem or None, seconds of Spark, seconds of the oracle)."""
    t = time.time()
    df = fn(spark, folder)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    t_spark = time.time() - t
    if sql is None:
        return len(got), "no SQL to compare with", t_spark, 0.0
    t = time.time()
    res = con.execute(sql)
    want_cols, want = [d[0] for d in res.description], res.fetchall()
    t_sql = time.time() - t
    if sorted(got_cols) != sorted(want_cols):
        return len(got), f"columns {sorted(got_cols)} != {sorted(want_cols)}", t_spark, t_sql
    a, b = rows(got_cols, got), rows(want_cols, want)
    if a != b:
        from collections import Counter

        ca, cb = Counter(a), Counter(b)
        return len(got), (f"rows {len(a)} vs {len(b)}; cols {sorted(got_cols)}\n   spark only {list((ca - cb).elements())[:3]}"
                          f"\n   oracle only {list((cb - ca).elements())[:3]}"), t_spark, t_sql
    return len(got), None, t_spark, t_sql


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from plumbline import queries
    from plumbline.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries.load()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in queries.QUERIES.items():
        if len(sys.argv) > 2 and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in sys.argv[2:]):
            continue
        try:
            n, problem, a, b = compare(spark, con, fn, queries.ORACLE.get(name), folder)
        except Exception as e:
            n, problem, a, b = 0, f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        bad += problem is not None
        tag = "BAD " if problem else "ok  " if name in queries.ORACLE else "rows"
        if problem or n == 0 or a > 3 or os.environ.get("VERBOSE"):
            print(f"{tag} {name:32s} n={n} spark={a:.2f}s sql={b:.2f}s {problem or ''}", flush=True)
    print("bad:", bad, "of", len(queries.QUERIES))
