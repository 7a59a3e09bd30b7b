"""Headline timings as one JSON line.

Reads $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]; each query runs once
warm-up and then three times, the median counts.  Results go to the noop sink,
so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.plans import QUERIES
from tidemark.session import Tables, scratch_path
from tidemark.sources import files as fs

HEADLINE = [
    "flag_statistics_ranked", "supplier_order_statistics", "orders_cube", "window_ranking", "window_running", "sample_random",
    "sample_stratified", "dedup_by_ranking", "join_inner", "star_join", "asof_join", "range_join", "theta_count", "pivot_sum",
    "profile_columns", "quality_report", "validation_violations", "pii_redact_text", "infer_schema", "changes_full_compare", "apply_changes",
    "merge_with_delete", "series_spikes", "series_gap_fill", "geo_radius_join", "session_windows", "full_text_search", "query_lint", "top_k_per_key",
]


def timed(run, repeats: int = 3) -> float:
    run()
    times = []
    for _ in range(repeats):
        t0 = time.perf_counter()
        run()
        times.append(time.perf_counter() - t0)
    return round(statistics.median(times), 4)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, root)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    queries = {n: timed(lambda n=n: noop(QUERIES[n](spark, root))) for n in HEADLINE}
    # the published goals: simple query latency, ingestion rate, training time
    simple = t.orders.where(F.col("o_orderkey") == 4242).select("o_custkey", "o_totalprice")
    simple_s = timed(lambda: simple.collect(), 5)
    rows = t.lineitem.count()
    ingest_s = timed(lambda: fs.export_table(t.lineitem, scratch_path(spark, "ingest")))
    t0 = time.perf_counter()
    noop(QUERIES["model_round_trip"](spark, root))
    train_s = round(time.perf_counter() - t0, 4)
    print(json.dumps({
        "metric": "headline queries, total seconds (median of 3, warm)", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries,
        "sf": root.rstrip("/").split("sf")[-1], "simple_query_sec": simple_s, "ingest_rows_per_sec": round(rows / ingest_s), "train_sec": train_s,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
