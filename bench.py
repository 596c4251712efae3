"""Run the headline queries at one scale and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and the cores. Every result
is written to Spark's ``noop`` sink, so that all rows and columns are computed and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from rewardloom.plans import catalog
from rewardloom.session import local_session

HEADLINES = (
    "a2_reward_statistics",
    "a2_full_scoring",
    "r6_anti_repetition",
    "r6_2_repeated_units",
    "r6_4_repeated_words",
    "r6_7_repeated_phrases",
    "r7_topic_relevance",
    "r8_text_similarity",
    "r9_typed_verification",
    "a1_value_counts",
    "a2_metric_statistics",
    "a4_token_entropy",
    "a7_kl_divergence",
    "a10_validation_report",
    "a12_run_comparison",
    "a15_reward_correlation",
    "a17_group_advantage",
    "j4_run_side_by_side",
    "w2_trends",
    "w5_moving_average",
    "w6_running_accuracy",
    "k1_generation_log",
    "t2_windowed_metrics",
    "t3_running_trends",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="bench-")
    # The tables are single files of one row group, which one core would read and score alone.
    spark = local_session("bench", cpus, **{"spark.checkpoint.dir": work, "spark.rewardloom.scanPartitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's compilers on a cheap query that is not timed.
    catalog.QUERIES["r1_correctness"](spark, sf_dir).count()
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
