"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query starts from the raw tables: artifacts of earlier queries are forgotten first.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from listingspark.plans import catalog, common
from listingspark.session import configured

HEADLINE = (
    "q1_integrity_issues", "q8_prepared_rows", "q9_repost_groups", "q10_coverage", "q12_numeric_profile", "q14_manual_review",
    "q16_latest_observation", "q18_components", "q19_consolidated_rows", "p2_fold_assignment", "p3_continued_splits",
    "m4_out_of_fold_medians", "g1_family_metrics", "g2_subgroup_metrics", "g5_removal_verdicts", "g8_support_reasons",
    "g14_holdout_gate", "e2_visible_text", "e15_source_reconciliation", "q21_quota_selection", "st1_incremental_ingest",
    "m6_ridge_fold_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configured(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    registered = catalog.queries()
    only = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        common.forget_stages()
        started = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "listing preparation and evaluation, total of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
