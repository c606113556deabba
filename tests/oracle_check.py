"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "float": "FLOAT"}


def _duck_norm(t: str) -> str:
    return {"NUMBER": "DOUBLE"}.get(t, t)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": False, "spark_sec": round(t_spark, 2)}
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "spark_sec": round(t_spark, 2)}
    out["cols_ok"] = sorted(s_cols) == sorted(d_cols)
    spark_types = {f.name: _SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    duck_types = {c[0]: str(c[1]) for c in res.description}
    bad_types = {c: (spark_types.get(c), duck_types.get(c)) for c in s_cols
                 if c in duck_types and spark_types.get(c) != _duck_norm(duck_types.get(c))}
    out["types_ok"] = not bad_types
    if bad_types:
        out["types"] = bad_types
    if not out["cols_ok"]:
        out["cols"] = (sorted(s_cols), sorted(d_cols))
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    out["values_ok"] = a == b
    if not out["values_ok"]:
        diff = [x for x in a if x not in set(b)][:3]
        out["spark_only"] = diff
        out["oracle_only"] = [x for x in b if x not in set(a)][:3]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    from seedlabel.session import get_spark
    spark = get_spark(cpus=8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "error": repr(e)[:500]}
        ok = r.get("values_ok", "error" not in r) and r.get("cols_ok", True) and r.get("types_ok", True)
        bad += not ok
        print(("OK  " if ok else "BAD ") + repr(r), flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
