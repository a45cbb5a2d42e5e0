"""Physical-plan summary of every query of the registry (each plan is executed
first, so the optimiser's final plan is shown; work that a query does while it
is built - written tables - is not in it): exchanges, join strategies, aggregate kinds,
windows, generators, and whether filters were pushed to a Parquet scan.

``python -m ragscope.plans.plan_report [sf_dir] > PLANS.md``
"""

from __future__ import annotations

import re
import sys

KINDS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
         "BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin", "ShuffledHashJoin", "HashAggregate",
         "ObjectHashAggregate", "SortAggregate", "Window", "WindowGroupLimit", "Generate", "MapInPandas",
         "ArrowEvalPython", "FlatMapGroupsInPandas", "TakeOrderedAndProject"]


def summarize(plan: str) -> dict:
    out = {}
    for k in KINDS:
        n = plan.count(k)
        if n:
            out[k] = n
    pushed = [m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if m]
    out["scans"] = len(re.findall(r"FileScan|Scan parquet", plan))
    out["pushed_filter_scans"] = len(pushed)
    return out


def main(argv):
    sys.path.insert(0, ".")
    from ragscope.session import checkpoint_dir, get_spark
    from ragscope.plans.registry import all_queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_spark()
    checkpoint_dir(spark)
    print(f"# Physical plans (final AQE plans, {sf_dir})\n")
    print("| query | operators |")
    print("|---|---|")
    for name, q in all_queries().items():
        try:
            df = q(spark, sf_dir)
            execution = df._jdf.queryExecution()
            execution.toRdd().count()  # runs this very plan
            plan = execution.executedPlan().toString().split("== Initial Plan ==")[0]
            s = summarize(plan)
            ops = ", ".join(f"{k} x{v}" for k, v in s.items() if v)
        except Exception as e:  # noqa: BLE001
            ops = f"ERROR {e!r}"[:200]
        print(f"| {name} | {ops} |", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
