"""Compare Spark queries with their DuckDB oracle SQL the way the driver does:
row count, column names (sorted) and an order-insensitive hash of the
values (doubles rounded)."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from clausefold.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(lines), h


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spark_cols = df.columns
    t1 = time.time()
    out = {"query": name, "spark_rows": len(rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(r) for r in res.fetchall()]
    out["duck_rows"] = len(drows)
    out["cols_match"] = sorted(spark_cols) == sorted(dcols)
    n1, h1 = digest(spark_cols, rows)
    n2, h2 = digest(dcols, drows)
    out["hash_match"] = h1 == h2
    out["status"] = "ok" if (out["cols_match"] and n1 == n2 and h1 == h2) else "MISMATCH"
    if out["status"] != "ok":
        out["spark_cols"] = spark_cols
        out["duck_cols"] = dcols
        order_s = sorted(range(len(spark_cols)), key=lambda i: spark_cols[i])
        order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
        a = sorted("|".join(_norm(r[i]) for i in order_s) for r in rows)
        b = sorted("|".join(_norm(r[i]) for i in order_d) for r in drows)
        sa, sb = set(a), set(b)
        out["only_spark"] = [x[:300] for x in sorted(sa - sb)[:3]]
        out["only_duck"] = [x[:300] for x in sorted(sb - sa)[:3]]
    return out


if __name__ == "__main__":
    import json

    from clausefold import get_spark
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    from clausefold.session import checkpoint_dir
    spark = get_spark("local[8]", shuffle_partitions=8)
    checkpoint_dir(spark)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, name, fn, sqls.get(name), sf, con)
        except Exception as e:  # report and continue
            r = {"query": name, "status": "ERROR", "error": str(e)[:800]}
        bad += r["status"] in ("MISMATCH", "ERROR")
        print(json.dumps(r, default=str), flush=True)
    print(json.dumps({"bad": bad, "total": len(only or qs)}))
