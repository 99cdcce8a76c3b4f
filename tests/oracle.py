"""Compares registered queries with their SQL: python tests/oracle.py [sf_dir] [names…]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(values) -> list[str]:
    def text(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v)

    return sorted("|".join(text(v) for v in row) for row in values)


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if the rows are the same."""
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    if sorted(want.columns) != names:
        return f"columns {names} and {sorted(want.columns)}"
    a = rows_of(tuple(r[c] for c in names) for r in got.collect())
    b = rows_of(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    if a == b:
        return ""
    odd = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only in Spark {odd[0]}, only in SQL {odd[1]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    where, *names = sys.argv[1:] or ["/root/testdata/sf0.01"]
    queries = entry.queries()
    for name, text in entry.oracle_sql().items():
        if not names or name in names:
            began = time.time()
            try:
                said = compare(session, queries[name], text, where)
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__}: {str(e)[:400]}"
            print(name, "ok" if not said else f"DIFFERS {said}", f"{time.time() - began:.1f} s", flush=True)
