"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then three times; the median counts. Results are drained into
the no-op sink, so that all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "p_profile_lineitem p_numeric_stats p_nulls_distinct p_value_counts p_detect_dates q_duplicates"
    " q_outliers_mad m_mask_text m_pii_report k_correlations r01_total_by_category r03_ratio_by_category"
    " r05_correlation r08_compare_groups r13_outlier_rows r15_period_change r17_top_groups"
    " r19_distribution r21_mode_per_category g10_aggregates g13_unique g19_time_bucket g21_rolling_time"
    " g22_rolling_rows g23_cumulative g25_window_share g26_rank g29_join_inner g30_asof g34_interpolate"
    " g42_cohort w2_metric_change w4_segment_summary v3_fold_categories t1_tokens t2_bm25 t6_recent_transcript"
    " s_csv_roundtrip f_delimiter e1_stream_buckets"
).split()


def session(cpus: str):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablewise-bench")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablewise-bench-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def timed(fn, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from queries.registry import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    queries = load()[0]
    seconds = {}
    for name in names:
        timed(queries[name], spark, sf_dir)
        seconds[name] = round(statistics.median(timed(queries[name], spark, sf_dir) for _ in range(runs)), 3)
        print(f"{seconds[name]:8.3f} {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, median of warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
