"""Run queries and their DuckDB twins side by side and report differences.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return None if math.isnan(f) else f + 0.0
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(spark_rows, duck_rows):
    if spark_rows[0] != duck_rows[0]:
        return f"columns {spark_rows[0]} != {duck_rows[0]}"
    a, b = spark_rows[1], duck_rows[1]
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:1]} {b[:1]}"
    if a == b:
        return None
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    x, y = bad[0]
    cells = [(c, p, q) for c, p, q in zip(spark_rows[0], x, y) if p != q]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {x[:3]}: {cells[:4]}"


def check(spark, con, name, query, sql, folder):
    started = time.time()
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return took, len(mine[1]), "no twin"
    rel = con.execute(sql)
    theirs = rows_of([d[0] for d in rel.description], rel.fetchall())
    return took, len(mine[1]), differences(mine, theirs)


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    folder, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sqls = connect(folder), entry.queries(), entry.oracle_sql()
    for name in names or list(queries):
        try:
            took, n, problem = check(spark, con, name, queries[name], sqls.get(name), folder)
        except Exception as error:
            took, n, problem = 0.0, -1, f"ERROR {str(error)[:500]}"
        print(f"{name:28s} {n:8d} {took:7.2f}s  {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
