"""Run registered queries next to their SQL twins in DuckDB and report differences.

python -m tests.harness [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import threading
import time

import duckdb

LIMIT = 150  # seconds per engine and query
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e6 else f"{v:.5f}".replace("-0.00000", "0.00000")
    return str(v)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(con, spark, fn, sql, sf_dir):
    watch = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
    watch.start()
    try:
        df = fn(spark, sf_dir)
        got, gcols = canonical([tuple(r) for r in df.collect()], df.columns)
    finally:
        watch.cancel()
    if sql is None:
        return None, len(got), "rows only"
    watch = threading.Timer(LIMIT, con.interrupt)
    watch.start()
    try:
        rel = con.execute(sql)
        cols = [d[0] for d in rel.description]
        types = {d[0]: str(d[1]) for d in rel.description}
        want, wcols = canonical(rel.fetchall(), cols)
    finally:
        watch.cancel()
    if gcols != wcols:
        return False, len(got), f"columns {gcols} != {wcols}"
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    bad = [(f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema.fields
           if kinds.get(f.dataType.simpleString()) != types[f.name]]
    if got != want:
        have, need = set(got), set(want)
        extra = sorted(have - need)[:3]
        lack = sorted(need - have)[:3]
        return False, len(got), f"rows {len(got)} vs {len(want)}\n   cols {gcols}\n   spark only {extra}\n   sql only {lack}"
    return (not bad), len(got), f"types {bad}" if bad else "ok"


def session(cpus="8"):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cpus}]").appName("ordertide")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())


def main():
    import __spark_entry__ as e
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    q, o = e.queries(), e.oracle_sql()
    names = [n for n in q if not args or any(n.startswith(a) for a in args)]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for n in names:
        t = time.time()
        try:
            ok, rows, note = compare(con, spark, q[n], o.get(n), sf)
        except Exception as ex:  # report and go on
            ok, rows, note = False, -1, f"{type(ex).__name__}: {str(ex)[:700]}"
        failed += ok is False
        print(f"{'FAIL' if ok is False else 'ok  '} {n} rows={rows} {time.time()-t:.1f}s {note if note != 'ok' else ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed, {sum(n in o for n in names)} with SQL")


if __name__ == "__main__":
    main()
