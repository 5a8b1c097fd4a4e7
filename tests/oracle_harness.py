"""Run registered queries on Spark and their SQL on DuckDB and compare.

Comparison: column names (sorted), coarse types, row count and the multiset of
rows (exact values; floats compared bit for bit after normalising -0.0).

Usage: python tests/oracle_harness.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

SPARK_TO_DUCK = {
    "LongType": "BIGINT", "IntegerType": "INTEGER", "ShortType": "SMALLINT", "ByteType": "TINYINT",
    "DoubleType": "DOUBLE", "FloatType": "FLOAT", "StringType": "VARCHAR", "BooleanType": "BOOLEAN",
}


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {f.name: type(f.dataType).__name__ for f in sdf.schema.fields}
    s_rows = [tuple(_norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    d_rows = [tuple(_norm(v) for _, v in sorted(zip(d_cols, r))) for r in rel.fetchall()]
    problems = []
    if sorted(sdf.columns) != sorted(d_cols):
        problems.append(f"columns spark-only={sorted(set(sdf.columns) - set(d_cols))} "
                        f"duck-only={sorted(set(d_cols) - set(sdf.columns))}")
    else:
        for c in sdf.columns:
            want = SPARK_TO_DUCK.get(s_types[c])
            if want and want != d_types[c]:
                problems.append(f"type {c}: spark {s_types[c]} duck {d_types[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    elif not problems:
        cs, cd = Counter(s_rows), Counter(d_rows)
        if cs != cd:
            only_s = list((cs - cd).elements())[:3]
            only_d = list((cd - cs).elements())[:3]
            problems.append(f"values differ: spark-only {only_s} duck-only {only_d} cols={sorted(sdf.columns)}")
    return problems, len(s_rows), t1 - t0


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    filters = [a for a in argv[1:] if not a.startswith("/")]
    from pdforge.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck_connection(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if filters and not any(f in name for f in filters):
            continue
        if name not in sqls:
            t0 = time.time()
            try:
                n = qs[name](spark, sf_dir).count()
                print(f"R   {name}: rows={n} ({time.time() - t0:.1f}s)")
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"ERR {name}: {type(e).__name__}: {str(e)[:400]}")
            continue
        try:
            problems, n, secs = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, n, secs = [f"{type(e).__name__}: {str(e)[:600]}"], -1, 0
        if problems:
            bad += 1
            print(f"BAD {name}: {problems}")
        else:
            print(f"OK  {name}: rows={n} ({secs:.1f}s)")
        sys.stdout.flush()
    print(f"done, {bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
