"""Side-by-side run of the catalogue in Spark and DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, oracle, sf):
    t0 = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if oracle is None:
        return True, f"rows-only {len(got[1])}", t1 - t0, 0.0
    rel = con.execute(oracle)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    t2 = time.time()
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", t1 - t0, t2 - t1
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, (f"rows {len(got[1])} vs {len(want[1])}; only spark {len(a - b)} e.g. {sorted(a - b)[:2]}; "
                       f"only sql {len(b - a)} e.g. {sorted(b - a)[:2]}"), t1 - t0, t2 - t1
    return True, f"{len(got[1])} rows", t1 - t0, t2 - t1


def main(argv):
    from tremora.session import build_session

    import __spark_entry__ as E

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle-check")
    con = connect(sf)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for n in argv or qs:
        try:
            ok, msg, ts, td = compare(spark, con, n, qs[n], os_.get(n), sf)
        except Exception as e:  # report and go on
            ok, msg, ts, td = False, f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {n:28s} {ts:6.2f}s {td:6.2f}s {msg}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
