"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

    python check_oracles.py [sf_dir] [name ...]

Compares row count, column names and the multiset of rows (floats rounded
to 9 significant digits).  Prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from fanin.plans.catalog import oracle_sql, queries
from fanin.session import build_session
from fanin.sources.fixtures import BASE_TABLES


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


TYPE_MAP = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
            "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "binary": "BLOB", "date": "DATE"}


def type_diffs(df, rel):
    spark_t = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    duck_t = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (spark_t[c], duck_t.get(c)) for c in spark_t if spark_t[c] != duck_t.get(c)}


def rows_of(records, cols):
    return Counter(tuple(_norm(r[c]) for c in cols) for r in records)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import os
    extra = {}
    tz = os.environ.get("CHECK_TZ")   # run under another session time zone to prove zone independence
    if tz:
        extra["spark.sql.session.timeZone"] = tz
    for kv in filter(None, os.environ.get("CHECK_CONF", "").split(",")):   # k=v,k=v: other session settings
        k, v = kv.split("=", 1)
        extra[k] = v
    spark = build_session(extra=extra or None)
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, orc = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = sorted(df.columns)
            srows = [r.asDict() for r in df.collect()]
            t1 = time.time()
            if name not in orc:
                print(f"{name:28s} rows-only n={len(srows)} spark={t1 - t0:.2f}s")
                continue
            rel = con.sql(orc[name])
            dcols = sorted(rel.columns)
            drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
            ok_cols = cols == dcols
            types = type_diffs(df, rel) if ok_cols else {}
            ok = ok_cols and not types and rows_of(srows, cols) == rows_of(drows, cols)
            bad += not ok
            print(f"{name:28s} {'OK ' if ok else 'BAD'} spark={len(srows)} duck={len(drows)} "
                  f"cols={'ok' if ok_cols else (cols, dcols)} types={types or 'ok'} spark={t1 - t0:.2f}s duck={time.time() - t1:.2f}s")
            if not ok and ok_cols:
                a, b = rows_of(srows, cols), rows_of(drows, cols)
                print("   spark-only:", list((a - b).items())[:3])
                print("   duck-only: ", list((b - a).items())[:3])
        except Exception as e:  # report and go on
            bad += 1
            print(f"{name:28s} ERR {type(e).__name__}: {str(e)[:400]}")
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
