"""Run headline queries and summarise their executed (AQE-final) plans, and the
plans (before AQE) of the stages that they store.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
For each query: shuffles, join strategies, windows, and the Parquet scans'
pushed filters / read schema of the final plan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from faultline import session  # noqa: E402
from faultline.plans.catalog import QUERIES  # noqa: E402
from faultline.session import get_spark  # noqa: E402

OPS = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
       "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "Window", "Generate", "HashAggregate", "SortAggregate", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16)
    print(f"# Executed plans of the headline queries ({sf_dir}, local[8], AQE on)\n")
    print("Counts are operators in the final adaptive plan of the query itself; rows below a query, marked ·, are the "
          "stages it stores as Parquet tables on the way (their plans before AQE).\n")
    stored = []
    session.on_store = lambda name, df: stored.append((name, df._jdf.queryExecution().executedPlan().toString()))
    print("| query | " + " | ".join(o.replace("Exchange ", "X ") for o in OPS) + " |")
    print("|---|" + "---|" * len(OPS))
    scans = {}
    for name in HEADLINE:
        stored.clear()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        for label, text in [(name, plan), *[(f"· {stage}", p) for stage, p in stored]]:
            counts = [len(re.findall(re.escape(o) + r"\b", text)) for o in OPS]
            print(f"| {label} | " + " | ".join(str(c) for c in counts) + " |")
        found = []
        for line in plan.splitlines():
            if "FileScan parquet" in line:
                pf = re.search(r"PushedFilters: (\[[^\]]*\]?)", line)
                rs = re.search(r"ReadSchema: (struct<[^ ]*)", line)
                found.append(f"{pf.group(1) if pf else ''} {rs.group(1)[:120] if rs else ''}".strip())
        scans[name] = sorted(set(found))[:8]
    print("\n## Parquet scans in the final plans\n")
    for name, s in scans.items():
        if s:
            print(f"* **{name}**")
            for x in s:
                print(f"  * `{x}`")


if __name__ == "__main__":
    main()
