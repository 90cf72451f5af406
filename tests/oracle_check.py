"""Compare registered queries with their reference SQL.

    python -m tests.oracle_check 0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("checks")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checks-")).config("spark.driver.memory", "10g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder):
    """Empty string if equal, else what differs."""
    df = fn(spark, folder)
    got_names = df.columns
    got = canonical([tuple(r) for r in df.collect()], got_names)
    if sql is None:
        return "" if got else "no rows", len(got)
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = canonical(res.fetchall(), want_names)
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    types = [(type(a), type(b)) for g, w in zip(got[:1], want[:1]) for a, b in zip(g, w)
             if a is not None and b is not None and type(a) is not type(b)]
    if types:
        return f"types {types}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)} rows differ, e.g.\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", len(got)
    return "", len(got)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = session(), connect(folder)
    todo, sqls, failed = queries(), oracle_sql(), []
    for name, fn in todo.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:
            problem, n = f"error {type(e).__name__}: {str(e)[:1500]}", -1
            if wanted:
                traceback.print_exc()
        mark = "FAIL" if problem else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name:28s} {n:8d} rows {time.time() - start:6.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
