"""Run a registered query in Spark and its oracle SQL in DuckDB; compare the results.

Comparison: same column names (sorted), same row count, and the same multiset of rows after
normalising values (floats rounded to 6 places, stamps to ISO text). Used by the tests and by
``python tests/oracle_harness.py [names...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

STRICT = os.environ.get("ORACLE_STRICT") == "1"  # compare floats bit for bit

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if STRICT else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def col_types(rows, cols) -> dict:
    """Python value types per column (non-null values only)."""
    out = {c: set() for c in cols}
    for r in rows[:2000]:
        for c, v in zip(cols, r):
            if v is not None:
                out[c].add(type(v).__name__)
    return {c: tuple(sorted(t)) for c, t in out.items()}


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    import __spark_entry__ as E
    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = [tuple(r) for r in cur.fetchall()]
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}"
        return res
    a, b = rows_key(s_rows, s_cols), rows_key(d_rows, d_cols)
    s_types, d_types = col_types(s_rows, s_cols), col_types(d_rows, d_cols)
    type_diff = {c: (s_types[c], d_types.get(c)) for c in s_types if s_types[c] != d_types.get(c)
                 and s_types[c] and d_types.get(c)}
    if type_diff:
        res["type_diff"] = type_diff
    if a == b and not type_diff:
        res["status"] = "match"
    elif a == b:
        res["status"] = "TYPES"
    else:
        res["status"] = "MISMATCH"
        sa, sb = set(a), set(b)
        res["only_spark"] = [x for x in a if x not in sb][:3]
        res["only_oracle"] = [x for x in b if x not in sa][:3]
        res["cols"] = sorted(s_cols)
    return res


def session():
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master("local[8]").appName("deskline-check")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.session.timeZone", "UTC")
            .getOrCreate())


if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as E
    names = sys.argv[1:] or list(E.queries())
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
