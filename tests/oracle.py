"""Runs registered queries and their SQL side by side.

    python tests/oracle.py [-d FOLDER] [NAME ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import signal
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(v) for v in row) for row in frame.astype(object).values.tolist())


def difference(spark_frame, sql_frame) -> str | None:
    """None when both hold the same columns, types and rows."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    for c in spark_frame.columns:
        if str(sql_frame[c].dtype) == "Int64" and spark_frame[c].dtype == "float64":
            # Integers with nulls: Spark's frames hold them as floats.
            sql_frame = sql_frame.astype({c: "float64"})
        if spark_frame[c].dtype != sql_frame[c].dtype:
            return f"type of {c}: {spark_frame[c].dtype} vs {sql_frame[c].dtype}"
    left, right = rows_of(spark_frame), rows_of(sql_frame)
    if len(left) != len(right):
        return f"{len(left)} vs {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}" if bad else None


def _too_slow(*_):
    raise TimeoutError("time limit")


def main() -> int:
    from quillstack.plans.registry import all_queries, all_sql
    from quillstack.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("-t", type=int, default=90, help="seconds per query")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session("8"), duck(args.d)
    queries, sql = all_queries(), all_sql()
    signal.signal(signal.SIGALRM, _too_slow)
    failed = []
    for name in queries:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        begin = time.time()
        signal.alarm(args.t)
        try:
            frame = queries[name](spark, args.d).toPandas()
            took = time.time() - begin
            begin = time.time()
            if name in sql:
                problem = difference(frame, con.sql(sql[name]).df())
            else:
                problem = None if len(frame) else "no rows"
            sql_took = time.time() - begin
        except Exception as error:  # report and go on with the next query
            problem, took, sql_took = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0
            if os.environ.get("TRACE"):
                traceback.print_exc()
            frame = ()
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        kind = "sql" if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {kind:4s} {len(frame):8d} rows "
              f"{took:6.2f}s {sql_took:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
