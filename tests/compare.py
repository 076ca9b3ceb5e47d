"""Run queries against their SQL in DuckDB: python tests/compare.py SF [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (v if math.isinf(v) else round(v, 6) + 0.0)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of_sql(con, sql: str):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def rows_of_df(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(x) for x in r) for r in df.select(*names).collect())


def difference(df, con, sql: str) -> str:
    (a, x), (b, y) = rows_of_df(df), rows_of_sql(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{sum(x.values())} and {sum(y.values())} rows; only Spark {list((x - y).items())[:3]}; only SQL {list((y - x).items())[:3]}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(sf), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            if name in sql:
                found = difference(queries[name](spark, sf), con, sql[name])
                print(name, found or "equal", f"{time.time() - t:.1f} s", flush=True)
            else:
                df = queries[name](spark, sf)
                rows = df.collect()
                print(name, "no SQL", len(rows), rows[:2], f"{time.time() - t:.1f} s", flush=True)
        except Exception as x:
            print(name, "FAILED", str(x)[:1500], flush=True)
