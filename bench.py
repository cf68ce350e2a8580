"""Times the headline queries: one JSON line with the median of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from rivulet.plans.catalogue import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["flagship_family_metrics", "prf_mcc", "roc_auc", "pr_auc", "feat_all", "feat_entropy", "ecod_score", "hst_mass", "conformal_p", "flow_stats", "cms_exact", "hll_estimate", "verdict_ttl", "quality_profile", "bal_replicate", "tau_fold", "trust_running", "trust_final", "alert_dedup", "distill_rules", "bh_cutoff", "lww_merge", "trimmed_mean", "phi_accrual", "energy_efficiency", "decision_loop", "rolling_cutoff", "heavy_sketch", "conformal_recent"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            begin = time.perf_counter()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
