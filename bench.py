"""Time the headline queries on one local session and print one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.
A run covers everything: planning, the jobs an operator starts itself, and writing
the full result to a sink that discards it.  ``growth`` is the time over that on the
smaller tables beside the given ones, where those exist: tenfold rows, so 10 would be
in proportion.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from plumbline.catalog import QUERIES
from plumbline.session import local_session

HEADLINE = [
    "heldout_by_subgroup", "one_vs_genuine", "auc_by", "roc_by_kind", "binary_metrics",
    "dedup_then_filter", "filter_then_dedup", "complete_samples", "coverage",
    "stratified_split", "split_by_group", "group_aware_split", "balance", "ranked", "uniform_k",
    "disjoint_check", "cross_stage_overlap", "audit", "issue_summary", "class_profile",
    "zscore", "fuse", "softmax", "span_mask", "per_class_prf", "summary", "motion_gate",
    "top_confident", "score", "verdict_record", "balanced_evaluation", "issues", "intake_stream",
    "fit_head", "pad_to_max", "attach_weights", "cross_validate", "length_batches", "list_assets",
]
#: Smaller tables for the growth figure.
SMALL = "sf0.01"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("plumbline-bench", cpus)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), SMALL)
    times: dict[str, float] = {}
    growth: dict[str, float] = {}

    def timed(name: str, folder: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        least = None
        if os.path.isdir(small) and small != sf_dir.rstrip("/"):
            least = [timed(name, small) for _ in range(2)][1]
        taken = [timed(name, sf_dir) for _ in range(runs + 1)]
        times[name] = round(statistics.median(taken[1:]), 3)
        if least:
            growth[name] = round(times[name] / least, 2)
        print(f"{name} {times[name]} {growth.get(name, '')}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "growth": growth, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
