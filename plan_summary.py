"""Print a markdown table of plan features for every registered query.

    python plan_summary.py [sf_dir] > PLANS.md

Counts come from the executed (AQE initial) physical plan: shuffles (``Exchange``
other than broadcasts), broadcast exchanges, partial top-k (``WindowGroupLimit``),
scans, and Python nodes.  The iterative queries materialise their levels while the
DataFrame is built, so their counts are those of the final plan over the last
checkpoint.
"""

from __future__ import annotations

import re
import sys

from fanin.plans.catalog import queries
from fanin.session import build_session


def features(plan: str) -> dict[str, int]:
    lines = plan.splitlines()
    return {
        "shuffles": sum(1 for ln in lines if re.search(r"\bExchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", ln)),
        "broadcasts": sum(1 for ln in lines if "BroadcastExchange" in ln),
        "partial top-k": sum(1 for ln in lines if "WindowGroupLimit" in ln and "Partial" in ln),
        "scans": sum(1 for ln in lines if "FileScan" in ln or "Scan ExistingRDD" in ln),
        "python": sum(1 for ln in lines if re.search(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|TransformWithStateInPandas", ln)),
    }


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    cols = ["shuffles", "broadcasts", "partial top-k", "scans", "python"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name, fn in sorted(queries().items()):
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        f = features(plan)
        print(f"| `{name}` | " + " | ".join(str(f[c]) for c in cols) + " |")


if __name__ == "__main__":
    main(sys.argv)
