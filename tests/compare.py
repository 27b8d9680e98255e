"""Compare registered queries with their SQL: python tests/compare.py SF_DIR [name ...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return f"{float(value):.6f}"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(con, spark_df, sql):
    """None when equal, else a description."""
    got = rows_of(spark_df.columns, spark_df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}", len(got)
    if got == want:
        return None, len(got)
    a, b = set(got), set(want)
    only = [next(iter(sorted(x - y)), None) for x, y in ((a, b), (b, a))]
    return f"rows {len(got)} != {len(want)}; only spark {only[0]}; only sql {only[1]}", len(got)


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        start = time.time()
        try:
            con = connect(sf_dir)
            df = queries[name](spark, sf_dir)
            if name in oracles:
                message, n = difference(con, df, oracles[name])
            else:
                message, n = None, df.count()
        except Exception as error:  # report and go on
            message, n = f"{type(error).__name__}: {str(error)[:600]}", 0
        bad += message is not None
        state = "ok" if message is None and name in oracles else "rows" if message is None else "BAD"
        print(f"{state:5}{name:36}{n:8} rows {time.time() - start:6.1f}s  {message or ''}"[:1200], flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
