"""Times queries in Spark and their SQL in DuckDB, and prints rows of a Markdown table.

Median of three runs each, after one run; what takes over LONG seconds runs once, and SQL is stopped after MOST. Usage:
python measure_baseline.py folder cores [name ...], all queries of plans/ if no names are given.
"""

from __future__ import annotations

import statistics
import sys
import threading
import time

import duckdb
from pyspark.sql import SparkSession

from strandmill.plans import catalog

LONG, MOST = 5, 20
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def times(run, n: int = 3) -> str:
    """Median seconds of n runs after a first one; of a first one over LONG seconds, that alone."""
    found = []
    for k in range(n + 1):
        began = time.time()
        try:
            run()
        except duckdb.InterruptException:
            return f"over {MOST}"
        found.append(time.time() - began)
        if found[0] > LONG:
            return f"{found[0]:.2f}"
    return f"{statistics.median(found[1:]):.2f}"


def main() -> None:
    sf_dir, cores, *names = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    con.execute(f"SET threads TO {cores}")
    def in_duckdb(sql: str) -> None:
        timer = threading.Timer(MOST, con.interrupt)
        timer.start()
        try:
            con.execute(sql).fetchall()
        finally:
            timer.cancel()

    for name in names or catalog.QUERIES:
        spark_s = times(lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
        sql = catalog.ORACLES.get(name)
        duck_s = times(lambda: in_duckdb(sql)) if sql else "no SQL"
        print(f"| {name} | {spark_s} | {duck_s} |", flush=True)


if __name__ == "__main__":
    main()
