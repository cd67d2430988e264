"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "segments", "interpolate_limit", "rolling_stats", "adaptive_threshold", "bandpass_iir", "detect_peaks",
    "candidates_scored", "event_features_shape", "sliding_features", "nearest_time_label", "class_quantiles",
    "kruskal", "corr_matrix", "pr_auc", "group_split", "welch_band_power",
)


def main() -> None:
    from pyspark.sql import SparkSession

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tripwave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")  # no Python call-site lookup per expression
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tripwave.plans.catalog import QUERIES

    chosen = sys.argv[1:] or HEADLINE
    QUERIES["large_gaps"](spark, folder).write.format("noop").mode("overwrite").save()  # JVM and reader warm-up
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
