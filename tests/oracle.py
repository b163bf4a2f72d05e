"""Spark query and DuckDB equivalent side by side: python tests/oracle.py SF_DIR NAME..."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, float) and math.isfinite(value):
        return repr(int(value)) if value == int(value) else f"{value:.10g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def compare(query, sql: str, spark, sf_dir: str) -> str:
    """'' if both give the same rows, else what differs."""
    t0 = time.time()
    mine = query(spark, sf_dir)
    columns = sorted(mine.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in mine.collect())
    t1 = time.time()
    found = connection(sf_dir).execute(sql)
    names = [x[0] for x in found.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted(tuple(_plain(r[i]) for i in order) for r in found.fetchall())
    print(f"{len(got)} rows, {t1 - t0:.1f} s, SQL {time.time() - t1:.1f} s", file=sys.stderr)
    if got == want:
        return ""
    only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} rows and {len(want)}; only here, by {columns}: {str(only[0])[:1500]}; only in SQL: {str(only[1])[:1500]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sorted(sqls):
        try:
            print(name, (compare(queries[name], sqls[name], session, sys.argv[1]) or "same") if name in sqls else f"{queries[name](session, sys.argv[1]).count()} rows, no SQL", flush=True)
        except Exception as error:
            print(name, "FAILED", str(error)[:700], flush=True)
