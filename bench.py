"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select the data and the cores.
The first query runs twice, so that session start-up is not counted; every other query runs once.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gaugework.plans import registry

HEADLINE = (
    "numeric_profile_lineitem", "histogram_lineitem", "column_counts_orders", "top_values_orders",
    "dataset_size_and_duplicates_events", "missingness_feature_links_orders", "outlier_stats_orders",
    "cramers_v_segment_status", "spearman_with_numeric_target_lineitem", "single_feature_scores_orders",
    "drift_by_time_events", "drift_by_split_orders", "slice_f1_documents", "collinear_pairs_orders",
    "feedback_duplicates_documents", "feedback_cleaning_report_documents", "feedback_triage_events",
    "term_weights_conversations", "dashboard_category_performance_events", "roc_auc_orders",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    seconds: dict[str, float] = {}
    for name in HEADLINE[:1] + HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
