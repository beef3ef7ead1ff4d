"""Run registered plans in Spark and their SQL in DuckDB; compare the results.

Usage: ``python tests/oracle_compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


_TYPES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "StringType()": "VARCHAR",
          "BooleanType()": "BOOLEAN", "DateType()": "DATE", "TimestampNTZType()": "TIMESTAMP",
          "DoubleType()": "DOUBLE"}


def _spark_type(t) -> str:
    return _TYPES.get(repr(t)) or repr(t).replace("DecimalType", "DECIMAL").replace(" ", "")


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    if isinstance(v, decimal.Decimal):
        return v.normalize() if v == v else "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return [cols[i] for i in order], out


def compare(spark, con, name: str, plan, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    df = plan(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["ok"] = None
        return res
    rel = con.sql(sql)
    d_types = {c: str(t).replace(" ", "") for c, t in zip(rel.columns, rel.types)}
    s_types = {f.name: _spark_type(f.dataType) for f in df.schema.fields}
    res["types_ok"] = s_types == d_types
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    res["duck_rows"] = len(d_rows)
    sc, sr = _rows(s_cols, s_rows)
    dc, dr = _rows(d_cols, d_rows)
    res["cols_ok"] = sc == dc
    res["rows_ok"] = sr == dr
    res["ok"] = res["cols_ok"] and res["rows_ok"]
    if not res["ok"]:
        res["spark_cols"], res["duck_cols"] = sc, dc
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        res["only_spark"], res["only_duck"] = diff_s, diff_d
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from tillkit.session import get_spark

    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "error": repr(e)[:600]}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"{len(names or qs) - bad} ok / {bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
