"""Physical-plan summary of every registered query: python tests/plan_report.py [sf_dir] > PLANS.md

Counts, per query, the shuffles, broadcasts, single-partition exchanges,
windows and Python nodes of the executed plan (before adaptive re-planning),
and the columns read from ``documents``.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quire.session import build_session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def summary(plan: str) -> dict:
    own = "\n".join(line for line in plan.split("\n") if "ReusedExchange" not in line)  # reused ones run once
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning)", own)),
        "broadcasts": own.count("BroadcastExchange"),
        "single": own.count("Exchange SinglePartition"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "python": len(re.findall(r"MapInPandas|MapInArrow|ArrowEvalPython|FlatMapGroupsInPandasWithState|FlatMap(?:Co)?GroupsInArrow", plan)),
        "docs_read": sorted(set(re.findall(r"documents\.parquet\].*?ReadSchema: (struct<[^>]*>)", plan))),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    print("# Physical plans\n")
    print(f"Plans of every registered query on `{sf_dir}`, before adaptive re-planning. `single` counts single-partition")
    print("exchanges; `tests/test_plans.py` checks that none of them carries raw rows. Reused exchanges are not counted.")
    print("Queries that write intermediate tables (streaming, iterative, packing, most operators of `quire.llm`) show the")
    print("plan of their last read.\n")
    print("| query | shuffles | broadcasts | single | windows | python nodes | documents columns read |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in entry.queries().items():
        try:
            plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            s = summary(plan)
            cols = "; ".join(x.replace("struct<", "").replace(">", "") for x in s["docs_read"]) or "–"
            print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['single']} | {s['windows']} | {s['python']} | {cols} |")
        except Exception as exc:  # noqa: BLE001
            print(f"| `{name}` | error: {type(exc).__name__} | | | | | |")


if __name__ == "__main__":
    main()
