"""Summarise the physical plans of the reports (writes PLANS.md).

Usage: ``python tests/plan_report.py [sf_dir] > PLANS.md``

Two views per report: the plan Spark picks on the test data (small tables
broadcast), and the plan with automatic broadcasting off — the shape a
cluster gets when every table that grows with the data is too big to
broadcast.  Counted: shuffle exchanges, sort-merge / broadcast joins,
reused exchanges, aggregates, windows, and the filters pushed into scans.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

REPORTS = ["item_activity_ledger", "stock_request_pick_sheet", "item_search", "item_usage_summary",
           "recent_supplier", "latest_requisition_status"]


def summary(plan: str) -> dict:
    return {
        "shuffle exchanges": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range exchanges (sort)": len(re.findall(r"Exchange rangepartitioning", plan)),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "broadcast hash joins": plan.count("BroadcastHashJoin"),
        "reused exchanges": plan.count("ReusedExchange"),
        "hash aggregates (partial)": len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", plan)),
        "windows": plan.count("Window ["),
        "cartesian / nested loop": plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin"),
        "python evaluation": plan.count("EvalPython"),
    }


def pushed(plan: str) -> list[str]:
    out = set()
    for line in plan.splitlines():
        if "FileScan parquet" in line and "PushedFilters" in line:
            table = re.search(r"/([a-z]+)\.parquet", line)
            filt = re.search(r"PushedFilters: \[(.*?)(?:\]|, ReadSchema)", line)
            if table and filt and ("GreaterThan" in filt.group(1) or "EqualTo" in filt.group(1)):
                out.add(f"{table.group(1)}: {filt.group(1)[:150]}")
    return sorted(out)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    from larder.session import build_session

    spark = build_session()
    queries = entry.queries()
    print("# Physical plan summary\n")
    print(f"Generated by `tests/plan_report.py` on `{sf_dir}` (Spark {spark.version}).\n")
    print("Columns: the plan Spark chooses on the test data, and the same query with automatic "
          "broadcasting disabled (`spark.sql.autoBroadcastJoinThreshold=-1`, AQE off), which "
          "approximates a cluster where every table that grows with the data must be shuffled.\n")
    for name in REPORTS:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        local = queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        big = queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        a, b = summary(local), summary(big)
        print(f"## {name}\n")
        print("| | test data | no broadcast |\n|---|---|---|")
        for k in a:
            print(f"| {k} | {a[k]} | {b[k]} |")
        print("\nFilters pushed into scans:\n")
        for p in pushed(local):
            print(f"- `{p}`")
        print()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    spark.conf.set("spark.sql.adaptive.enabled", "true")


if __name__ == "__main__":
    main()
