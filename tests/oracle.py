"""Run registered queries next to their SQL on the same parquet files and compare all rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def spark_session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def views(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in df.select(*cols).collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = cur.fetchall()
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    cols, got = spark_rows(df)
    names, want = sql_rows(con, sql)
    if cols != names:
        return f"columns {cols} != {names}"
    if got == want:
        return ""
    a, b = set(got), set(want)
    return (f"rows {len(got)} vs {len(want)}; only spark {len(a - b)}: {sorted(a - b)[:3]}; "
            f"only sql {len(b - a)}: {sorted(b - a)[:3]}; cols {cols}")


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "sf0.01"
    chosen = set(argv[1:])
    folder = f"{DATA}/{sf}"
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = views(folder)
    sql = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                problem = compare(df, con, sql[name])
                n = ""
            else:
                n = df.count()
                problem = ""
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", ""
        took = time.time() - start
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {'' if name in sql else f'rows-only {n}'} {problem}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} failing: {' '.join(bad)}")


if __name__ == "__main__":
    main(sys.argv[1:])
