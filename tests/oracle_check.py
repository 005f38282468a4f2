"""Run registered Spark queries next to their DuckDB oracle and compare.

Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``

Comparison: same column names, compatible types, same row count and the same
multiset of rows (values rendered exactly: decimals keep their scale).
"""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SPARK_TO_DUCK = {
    "IntegerType": "INTEGER", "LongType": "BIGINT", "StringType": "VARCHAR",
    "TimestampNTZType": "TIMESTAMP", "DateType": "DATE", "DoubleType": "DOUBLE",
}


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TEST_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def render(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, dt.datetime):
        return ("ts", v.isoformat())
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    if isinstance(v, float):
        return ("f", repr(round(v, 9)))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def spark_type_name(dtype) -> str:
    name = type(dtype).__name__
    if name == "DecimalType":
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    return SPARK_TO_DUCK.get(name, name)


def compare(spark, con, name: str, sf_dir: str, plan, sql: str | None) -> dict:
    t0 = time.time()
    df = plan(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t0
    s_cols = df.columns
    s_types = [spark_type_name(f.dataType) for f in df.schema.fields]
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["status"] = "no-oracle"
        return out
    t0 = time.time()
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    out["duck_sec"] = round(time.time() - t0, 2)
    out["duck_rows"] = len(d_rows)
    problems = []
    if s_cols != d_cols:
        if sorted(s_cols) == sorted(d_cols):
            # align the oracle to Spark's column order
            idx = [d_cols.index(c) for c in s_cols]
            d_rows = [tuple(r[i] for i in idx) for r in d_rows]
            d_types = [d_types[i] for i in idx]
        else:
            problems.append(f"columns spark={s_cols} duck={d_cols}")
    if not problems:
        for c, st, dtp in zip(s_cols, s_types, d_types):
            if st != dtp:
                problems.append(f"type {c}: spark={st} duck={dtp}")
        a = collections.Counter(tuple(render(v) for v in r) for r in s_rows)
        b = collections.Counter(tuple(render(v) for v in r) for r in d_rows)
        if a != b:
            only_s = list((a - b).elements())[:3]
            only_d = list((b - a).elements())[:3]
            problems.append(f"rows differ: spark-only={only_s} duck-only={only_d}")
    out["status"] = "ok" if not problems else "FAIL"
    if problems:
        out["problems"] = problems
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    import __spark_entry__ as entry
    from larder.session import build_session

    spark = build_session()
    con = duck_connection(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            res = compare(spark, con, name, sf_dir, qs[name], sqls.get(name))
        except Exception as exc:  # report and continue
            res = {"name": name, "status": "ERROR", "error": repr(exc)[:600]}
        bad += res["status"] not in ("ok", "no-oracle")
        print(res, flush=True)
    print(f"{len(names or qs) - bad} ok / {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
