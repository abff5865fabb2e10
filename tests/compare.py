"""Compare the registered queries with their SQL in DuckDB: ``python -m tests.compare [name ...]``."""

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if value is None:
        return "\0"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, name, sf):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), "no SQL"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(rel.columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} <> {sorted(rel.columns)}"
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    if a == b:
        return len(got), "same"
    extra, missing = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return len(got), f"DIFFERENT {len(a)} <> {len(b)}: ours {extra} theirs {missing}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "10g")
        .config("spark.sql.warehouse.dir", os.environ.get("RUN_DIR", "/tmp/compare") + "/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    for name in sys.argv[1:] or entry.queries():
        start = time.time()
        try:
            n, verdict = check(spark, name, sf)
        except Exception as error:  # noqa: BLE001
            n, verdict = -1, f"ERROR {str(error)[:600]}"
        print(f"{name:24s} {n:8d} {time.time() - start:7.2f}s {verdict}", flush=True)
