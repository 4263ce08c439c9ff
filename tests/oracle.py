"""Compare registered queries with their check SQL: ``python tests/oracle.py SF [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
DATA = "/root/testdata"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


# DuckDB type name -> Spark type name.
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float", "SMALLINT": "smallint", "BLOB": "binary",
}


def compare(spark, con, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    global spark_seconds
    spark_seconds = time.time() - start
    rel = con.sql(sql)
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if sorted(rel.columns) != names:
        return f"columns differ: {names} / {sorted(rel.columns)}", len(got)
    rows = rel.fetchall()
    order = [rel.columns.index(c) for c in names]
    want = [tuple(_plain(r[i]) for i in order) for r in rows]
    spark_types = dict(df.dtypes)
    odd = {c: (spark_types[c], types[c]) for c in names if TYPES.get(types[c], types[c]) != spark_types[c]}
    if odd:
        return f"types differ: {odd}", len(got)
    got.sort(key=repr)
    want.sort(key=repr)
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"values differ: {len(got)} / {len(want)} rows, e.g. {str(diff)[:600]}", len(got)
    return None, len(got)


def main():
    sf, only = sys.argv[1], sys.argv[2:]
    sf_dir = f"{DATA}/sf{sf}"
    from tidemark.session import build_session

    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    global spark_seconds
    con = connect(sf_dir)
    checks, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start, spark_seconds = time.time(), None
        try:
            if name in checks:
                problem, n = compare(spark, con, fn, checks[name], sf_dir)
            else:
                n, problem = len(fn(spark, sf_dir).collect()), None
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        kind = "sql " if name in checks else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:28s} rows={n:<7d} {spark_seconds or time.time() - start:6.2f}s {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
