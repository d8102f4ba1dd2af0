"""Summarise the final (post-AQE) physical plan of every registered query.

usage: python tools/plan_report.py [sf_dir] > PLANS.md   (default sf0.01)
Per query: parquet scans per table (with whether filters were pushed), join
strategies, shuffles, single-partition exchanges (over aggregated rows by
design), windows, aggregates, Expand and Python (Arrow) operators.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def executed(plan: str) -> str:
    """The plan that ran: each adaptive plan, also one inside a subquery, ends where its initial plan begins at the same depth."""
    out, skip = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :|+-"))
        if skip is not None and line.strip(" :|+-") and depth < skip and "== Initial Plan ==" not in line:
            skip = None
        if "== Initial Plan ==" in line:
            skip = depth
        if skip is None:
            out.append(line)
    return "\n".join(out)


def summarise(plan: str) -> dict:
    final = executed(plan)
    scans = Counter(re.findall(r"FileScan parquet [^\n]*?/([a-z_]+)\.parquet", final))
    pushed = len(re.findall(r"PushedFilters: \[[^\]]*(GreaterThan|LessThan|EqualTo|In\()", final))
    return {
        "scans": ", ".join(f"{t}x{n}" for t, n in sorted(scans.items())) or "-",
        "range/eq filters pushed": pushed,
        "BHJ": final.count("BroadcastHashJoin"),
        "SMJ": final.count("SortMergeJoin"),
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning)", final)),
        "single-partition": final.count("Exchange SinglePartition"),
        "windows": len(re.findall(r"\bWindow \[", final)) + final.count("WindowGroupLimit"),
        "hash/sort agg": f"{final.count('HashAggregate')}/{final.count('SortAggregate')}",
        "Expand": final.count("Expand ["),
        "python": final.count("MapInPandas") + final.count("ArrowEvalPython"),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from upswell.session import build_session
    from upswell.plans.contract import QUERIES

    spark = build_session(master="local[8]", shuffle_partitions=8)
    rows = []
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        df.collect()  # after execution the plan below is the final AQE plan
        rows.append((name, summarise(df._jdf.queryExecution().executedPlan().toString())))
    cols = list(rows[0][1])
    print(f"# Final physical plans at {os.path.basename(sf)} (generated by tools/plan_report.py)\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---" * (len(cols) + 1) + "|")
    for name, s in rows:
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
