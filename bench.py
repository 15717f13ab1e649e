"""Times the headline queries, and DuckDB on the same tables; prints one line of JSON."""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Callable
from statistics import median

import duckdb
from pyspark.sql import SparkSession

from sessionloom.plans import oracle
from sessionloom.plans import queries as recommender

HEADLINE = (
    "co_visit_topn", "co_counts_typed", "pair_features", "session_stats", "session_item_ranks", "knn_exact",
    "cluster_popularity", "session_embedding", "source_flags", "features_full", "rank_topk", "submission_strings",
    "recall_weighted", "basket_co_visit",
)


def timed(run: Callable[[], object]) -> float:
    """The median of two runs after a warm-up."""
    runs = []
    for _ in range(3):
        began = time.perf_counter()
        run()
        runs.append(time.perf_counter() - began)
    return round(median(runs[1:]), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute(f"SET threads = {cpus}")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        parts = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{parts}')")
    took, other, sql = {}, {}, oracle.oracle_sql()
    for name in HEADLINE:
        query = recommender.queries()[name]
        took[name] = timed(lambda: query(spark, folder).write.format("noop").mode("overwrite").save())
        other[name] = timed(lambda: con.execute(sql[name]).fetch_arrow_table())
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "duckdb": other, "sf": folder.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
