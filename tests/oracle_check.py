"""Run registered queries in Spark and their oracle SQL in DuckDB and compare results
(column names sorted, rows sorted, floats within 1e-9 relative).

    python tests/oracle_check.py [sf_dir] [key ...]
"""
from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    status = []
    if sorted(scols) != sorted(dcols):
        status.append(f"cols spark={sorted(scols)} duck={sorted(dcols)}")
    if len(srows) != len(drows):
        status.append(f"rows spark={len(srows)} duck={len(drows)}")
    if not status:
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            status.append(f"{len(bad)} differing rows, e.g. spark={str(bad[0][0])[:300]} duck={str(bad[0][1])[:300]}")
    ok = not status
    print(f"{'OK ' if ok else 'BAD'} {key:32s} rows={len(srows):7d} spark={t1 - t0:6.2f}s duck={t2 - t1:5.2f}s "
          + "; ".join(status), flush=True)
    return ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from fansignal.session import build_session
    spark = build_session(shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    failed = []
    for k in (keys or list(qs)):
        if k not in sqls:
            n = qs[k](spark, sf_dir).count()
            print(f"--  {k:32s} rows={n:7d} (no oracle)")
            continue
        try:
            if not compare(spark, con, k, qs[k], sqls[k], sf_dir):
                failed.append(k)
        except Exception as e:  # report and continue
            print(f"ERR {k}: {type(e).__name__}: {str(e)[:600]}")
            failed.append(k)
    print("FAILED:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
