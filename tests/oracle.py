"""Registered queries against DuckDB on the same tables."""

import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in data)


def differs(spark, connection, run, sql, sf_dir):
    """What is wrong, or an empty string."""
    df = run(spark, sf_dir)
    want = connection.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {df.columns} and {want.columns}"
    a, b = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    return "" if a == b else f"{len(a)} rows and {len(b)}: {sorted(set(a) - set(b))[:3]} {sorted(set(b) - set(a))[:3]}"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    import __spark_entry__ as e

    s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    d = sys.argv[1]
    c, q, o = connect(d), e.queries(), e.oracle_sql()
    for n in sorted(o):
        if len(sys.argv) > 2 and not any(n.startswith(p) for p in sys.argv[2:]):
            continue
        at = time.time()
        try:
            found = differs(s, c, q[n], o[n], d)
        except Exception as x:  # shown, and the next one runs
            found = f"{type(x).__name__} {str(x)[:500]}"
        print("OK " if not found else "BAD", n, f"{time.time() - at:.1f}", found, flush=True)
    print("without SQL:", sorted(set(q) - set(o)))
