"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver).  One untimed warm-up query
starts the JVM and the Python workers first; each query is then timed three
times and the fastest run is reported (the VM's timings vary by tens of percent).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fanin.plans.catalog import queries  # noqa: E402
from fanin.session import build_session  # noqa: E402

# SURVEY §6: rows 4, 13, 16, 22, 26, 29, 41, 51 -- plus the report and the whole research call.
HEADLINE = ["retrieve_ranked", "canonical_url", "fuse_interleave_topk", "resolve_winner", "extract_text",
            "host_boilerplate", "ttl_replay", "coverage", "report_rows", "research_report"]


def run(spark, fn, sf):
    t0 = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          extra={"spark.driver.memory": "16g"})
    qs = queries()
    run(spark, qs["scan_captures"], sf)   # warm-up, untimed
    times = {}
    for name in HEADLINE:
        times[name] = round(min(run(spark, qs[name], sf) for _ in range(3)), 3)
    sf_name = os.path.basename(sf.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name.replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
