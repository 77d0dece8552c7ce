"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed (median of three runs, one if
a run takes long). The result goes to a no-op sink: all rows and columns are
computed, nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "dedup_last", "user_mean_center", "double_center", "item_stats", "popularity_ids", "knn_topk", "knn_topk_parts",
    "knn_predict", "knn2_predict", "als_rank1", "als2_rank1", "als_k20", "als_ml", "wals_rank1", "als_foldin",
    "svd_power1", "svd_k20", "svdknn", "pca_power1", "nmf_k10", "efa_rank1", "sgd_epoch", "lasso_descent", "balse_switch",
    "cfm", "fma", "gbr", "recommend_group", "rmse_mae", "dcg_ndcg", "compare_models", "vector_sum_wrap", "quorum_sum",
    "stream_item_stats", "stream_foldin",
]
LONG = 3.0


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from affinis.plans.catalog import QUERIES

    only = sys.argv[1:] or HEADLINE
    times = {}
    for name in only:
        first = run(QUERIES[name], spark, folder)
        runs = [run(QUERIES[name], spark, folder) for _ in range(1 if first > LONG else 3)]
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
