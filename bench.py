"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   table folder, default /root/testdata/sf0.1
    BENCH_CPUS     local cores, default 8
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "effectiveness_verdicts",
    "gated_escalation",
    "held_out_regression",
    "pattern_stats",
    "check_report",
    "stream_checks",
    "enforcement_fires",
    "turn_rule_fires",
    "rated_turns",
    "policy_verdicts",
    "rate_limited",
    "judge_quorum",
    "suite_run",
    "skill_gate",
    "edit_outcomes",
    "queue_history",
    "snapshot_diff",
    "near_duplicates",
    "deduped_bullets",
    "lesson_retrieval",
    "bfs_depth3",
    "components",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from feedloom.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("feedloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
