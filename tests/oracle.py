"""Compare Spark queries with their SQL on the same parquet tables.

    python tests/oracle.py [name-prefix ...] [--sf DIR]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(norm(x) for x in v) + "]"
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return f"b{bool(v)}"
    if isinstance(v, (pd.Timestamp,)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"f{float(v):.9g}"
    if isinstance(v, int) or type(v).__name__.startswith(("int", "uint")):
        return f"i{int(v)}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


def close(a, b):
    """Equal up to one unit of the sixth decimal: a mean that sits on a decimal tie rounds either way."""
    def split(row):
        parts = row.split("|")
        return [p for p in parts if not p.startswith("f")], [float(p[1:]) for p in parts if p[:1] == "f" and p[1:2] in "-0123456789"]

    x, y = sorted(map(split, a)), sorted(map(split, b))
    return all(p[0] == q[0] and len(p[1]) == len(q[1]) and all(abs(u - v) <= 1.1e-6 * max(1, abs(u)) for u, v in zip(p[1], q[1]))
               for p, q in zip(x, y))


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"rows={len(got)} (no SQL)"
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return True, f"rows={len(a)}"
    if len(a) == len(b) and close(a, b):
        return True, f"rows={len(a)} (equal up to decimal ties)"
    sa, sb = set(a), set(b)
    only_a = [x for x in a if x not in sb][:3]
    only_b = [x for x in b if x not in sa][:3]
    return False, f"spark {len(a)} rows, sql {len(b)} rows\n     spark: {only_a}\n     sql:   {only_b}"


if __name__ == "__main__":
    from barlab.session import build_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "10g",
           "spark.ui.showConsoleProgress": "false",
           "spark.driver.host": "127.0.0.1"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = []
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, fn, entry.oracle_sql().get(name), sf)
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {time.time() - t:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    spark.stop()
