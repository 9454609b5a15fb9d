"""Run registered queries beside their SQL: python tests/oracle_check.py [folder] [query ...]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def normal(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return "NULL" if value is None else str(value)


def compare(spark, folder, name, query, sql):
    """None if rows, names and type families agree, else what differs."""
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = sorted(tuple(normal(r[c]) for c in names) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    con.execute("SET TimeZone='UTC'")
    result = con.execute(sql)
    found = [c[0] for c in result.description]
    if sorted(found) != names:
        return f"columns {names} / {sorted(found)}"
    order = [found.index(c) for c in names]
    theirs = sorted(tuple(normal(r[i]) for i in order) for r in result.fetchall())
    if ours == theirs:
        return None if ours else "no rows"
    a = [r for r in ours if r not in set(theirs)][:2]
    b = [r for r in theirs if r not in set(ours)][:2]
    return f"{len(ours)} / {len(theirs)} rows; only ours {a}; only theirs {b}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, query in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            problem = compare(spark, folder, name, query, entry.oracle_sql()[name])
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"RESULT {'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("RESULT bad:", bad)
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
