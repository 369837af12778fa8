"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

    python tools/check_queries.py [sf_dir] [name ...]

Columns are compared by name (sorted), rows as an order-free multiset of
normalised values (floats and decimals to 6 places).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


STRICT = os.environ.get("CHECK_STRICT") == "1"


def norm(v):
    if v is None:
        return None
    if STRICT and isinstance(v, (float, decimal.Decimal)):
        return repr(v)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return str(v)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows, dict(df.dtypes)


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    types = dict(zip(names, [str(t) for t in rel.types]))
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    rows = [tuple(norm(r[i]) for i in idx) for r in data]
    return cols, rows, types


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def compare(spark, con, name, q, sf_dir):
    t0 = time.time()
    cols, rows, stypes = spark_rows(q.run(spark, sf_dir))
    ts = time.time() - t0
    if q.sql is None:
        return {"name": name, "status": "rows-only", "rows": len(rows), "spark_s": round(ts, 2)}
    dcols, drows, dtypes = duck_rows(con, q.sql)
    out = {"name": name, "rows": len(rows), "oracle_rows": len(drows), "spark_s": round(ts, 2)}
    if cols != dcols:
        out.update(status="COLUMNS", spark_cols=cols, oracle_cols=dcols)
        return out
    a, b = sorted(rows, key=_key), sorted(drows, key=_key)
    if a == b:
        out["status"] = "ok"
    else:
        sa, sb = set(a), set(b)
        out.update(status="VALUES", only_spark=[r for r in a if r not in sb][:3],
                   only_oracle=[r for r in b if r not in sa][:3])
    out["types"] = {c: (stypes.get(c), dtypes.get(c)) for c in cols}
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from ledgerlens.plans.catalog import all_queries
    from ledgerlens.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs = all_queries()
    bad = 0
    for name in names or sorted(qs):
        try:
            res = compare(spark, con, name, qs[name], sf_dir)
        except Exception as e:  # report and go on
            res = {"name": name, "status": "ERROR", "error": repr(e)[:600]}
        if res["status"] not in ("ok", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"{len(names or qs) - bad} ok / {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
