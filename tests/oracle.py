"""Compare the registered queries with their SQL in DuckDB.

    python tests/oracle.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def spark_rows(frame) -> tuple[list[str], Counter]:
    names = sorted(frame.columns)
    return names, Counter(tuple(row) for row in frame.select(*names).collect())


def duck_rows(connection, sql: str) -> tuple[list[str], Counter]:
    cursor = connection.execute(sql)
    found = [column[0] for column in cursor.description]
    places = [found.index(name) for name in sorted(found)]
    rows = Counter(tuple(row[place] for place in places) for row in cursor.fetchall())
    return sorted(found), rows


def differences(spark, connection, folder: str, run, sql: str) -> str:
    names, rows = spark_rows(run(spark, folder))
    wanted_names, wanted = duck_rows(connection, sql)
    if names != wanted_names:
        return f"columns {names} instead of {wanted_names}"
    if rows != wanted:
        extra, lacking = rows - wanted, wanted - rows
        return (
            f"{sum(rows.values())} rows instead of {sum(wanted.values())}; "
            f"extra {list(extra)[:2]}; lacking {list(lacking)[:2]}"
        )
    return ""


def main() -> None:
    import __spark_entry__ as registered
    from pyspark.sql import SparkSession

    runs, sqls = registered.queries(), registered.oracle_sql()
    folder = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in sys.argv[2:] or runs:
        begin = time.time()
        try:
            problem = differences(spark, connection, folder, runs[name], sqls[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{name:32s} {time.time() - begin:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{failed} of {len(sys.argv[2:] or runs)} differ")


if __name__ == "__main__":
    main()
