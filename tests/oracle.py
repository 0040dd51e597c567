"""Side-by-side check of a registered Spark query against its DuckDB SQL:
row count, column names and an order-insensitive value comparison."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        return (2, f"{round(v, 6):.6f}")
    if isinstance(v, int):
        return (2, f"{float(v):.6f}") if abs(v) < 2**53 else (3, str(v))
    if isinstance(v, (list, tuple)):
        return (4, repr([_norm(x) for x in v]))
    if isinstance(v, dict):
        return (4, repr(sorted((k, _norm(x)) for k, x in v.items())))
    return (5, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT"}


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from docrevise.plans.registry import REGISTRY
    q = REGISTRY[name]
    df = q.build(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "spark_rows": len(s_rows), "spark_cols": s_cols}
    if q.sql is None:
        out["oracle"] = None
        return out
    con = con or duck(sf_dir)
    rel = con.sql(q.sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out.update(duck_rows=len(d_rows), duck_cols=d_cols)
    s_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    out["types_match"] = s_types == d_types
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    out["count_match"] = len(s_rows) == len(d_rows)
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    out["values_match"] = a == b
    if not out["values_match"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = [r for r in a if r not in sb][:3]
        out["only_duck"] = [r for r in b if r not in sa][:3]
    return out


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from docrevise.session import get_spark
    import docrevise.plans.catalog  # noqa: F401  (registers everything)
    from docrevise.plans.registry import REGISTRY
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(REGISTRY)
    spark = get_spark()
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and go on
            r = {"name": n, "error": repr(e)[:2000]}
        ok = r.get("oracle", 1) is None or (r.get("cols_match") and r.get("count_match") and r.get("values_match"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + repr(r)[:3000], flush=True)
    print("bad:", bad)
