"""Time the headline queries and print one JSON line.

``resolved_pairs`` runs from the raw tables. The reports
read the stored pair and decision tables; building those is timed on its own
(``store_pairs``, ``store_decisions``), so nothing is hidden in a warm cache.
"""

from __future__ import annotations

import json
import os
import sys
import time

from twinfold import catalog
from twinfold.catalog import gating, samples
from twinfold.session import local_session

HEADLINE = (
    "tiered_match", "resolved_pairs", "classify_pairs", "decision_counts", "wide_compare", "review_queue",
    "corrections_manifest", "held_corrections", "salary_delta_distribution", "salary_delta_buckets", "wave_rows",
    "salary_anomalies", "suspicious_defaults", "run_overview", "diff_pairs", "trends", "key_overlap",
    "review_candidates_tiered", "dedupe_best", "map_snapshot", "audit_row_checks", "audit_duplicates",
    "audit_completeness", "audit_manager_loops", "issue_frame",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    samples.snap_old(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executors

    seconds: dict[str, float] = {}

    def timed(name, work):
        started = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)

    timed("store_pairs", lambda: samples.pairs(spark, sf_dir))
    timed("store_decisions", lambda: gating.gated(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
