"""Headline queries timed on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "order_lines",
    "product_stat",
    "product_user_reach",
    "user_product_stat",
    "purchase_gap_stats",
    "candidate_labels",
    "training_mart",
    "lgbm_features",
    "compact_mart",
    "recency_mart",
    "basket_size_mart",
    "rolling_features",
    "seq_history_product",
    "seq_padded",
    "submission_with_none",
    "mean_f1_by_threshold",
    "f1_baskets",
]


def make_session() -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cartwise")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from cartwise.queries import ENTRIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = make_session()
    timings = {}
    for name in HEADLINE:
        started = time.time()
        ENTRIES[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
