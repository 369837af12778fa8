"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs ``BENCH_RUNS`` times (3) to completion through the ``noop`` sink
(the whole plan executes, nothing is collected) and its median counts, after a warm-up pass of the same queries on
the smallest tables (``BENCH_WARM_DIR``, empty to skip).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # summarise (dated ledger lineitem x part)
    "spend_tree_ytd", "spend_tree_mtd", "summary_labels",
    # prepare
    "clean_text", "dedupe_first", "build_vocab", "token_ids",
    # learn and score (documents)
    "train_nb", "predict_both", "evaluate_nb",
    "train_lr", "predict_udf",
    # augment
    "augment_city", "shuffle_words",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ledgerlens.plans.catalog import all_queries
    from ledgerlens.session import get_spark

    spark = get_spark(f"local[{cpus}]", app="ledgerlens-bench",
                      shuffle_partitions=max(8, int(cpus) * 2),
                      extra_conf={"spark.driver.memory": "16g"})
    qs = all_queries()
    # JVM warm-up outside the timings: class loading, JIT and code generation
    # for the same query shapes on the smallest tables, then the Parquet
    # footers of the measured tables
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if warm_dir and os.path.isdir(warm_dir):
        for name in HEADLINE:
            qs[name].run(spark, warm_dir).write.format("noop").mode("overwrite").save()
    for t in ("part", "lineitem", "documents", "customer", "nation"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").count()

    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            t0 = time.perf_counter()
            qs[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(taken), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf,
                      "cpus": int(cpus), "runs": runs, "warmup": warm_dir or None}))


if __name__ == "__main__":
    main()
