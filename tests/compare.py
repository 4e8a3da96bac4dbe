"""Run registered queries on Spark and their SQL on DuckDB over the same tables and compare all rows."""

from __future__ import annotations

import glob
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, query, sql):
    """NULL if equal, else a short text."""
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} against {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import time

    from pagewright.plans.oracles import ORACLES
    from pagewright.plans.queries import QUERIES
    from pagewright.session import build_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    for n in names:
        t = time.time()
        try:
            result = compare(spark, con, folder, n, QUERIES[n], ORACLES[n]) if n in ORACLES else f"no SQL, {QUERIES[n](spark, folder).count()} rows"
        except Exception as e:
            result = f"ERROR {str(e)[:600]}"
        print(n, "ok" if result is None else result[:1200], round(time.time() - t, 1), flush=True)
