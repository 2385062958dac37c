"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query runs to completion through the ``noop`` sink (the whole plan is
executed, nothing is pulled to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.plans.catalog import QUERIES  # noqa: E402
from faultline.session import get_spark  # noqa: E402

HEADLINE = [
    "release_activity", "ticket_versions", "injected_versions", "fix_commits", "labelled_snapshots",
    "file_churn", "line_churn", "nesting_depth", "smell_counts", "method_dataset", "spearman_ranking",
    "info_gain_fixed_bins", "folds", "fold_metrics", "gaussian_nb_scores", "knn_scores", "whatif_summary",
    "info_gain_mdl", "smote_balance", "cv_by_project",
    "line_diff", "snapshot_tree", "method_owner", "first_parent_order", "tree_nodes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="faultline-bench", shuffle_partitions=int(cpus) * 2)
    times = {}
    for name in only:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
