"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores, BENCH_RUNS the runs
(default 3) whose median counts after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from voxframe.plans.catalog import REGISTRY
from voxframe.session import build_session

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ["density_correlation", "sv_map", "merge_patches", "metrics_global_and_mask", "resample_linear",
            "resample_diagonal", "connected_components", "closing", "region_props", "points_to_cells"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    REGISTRY["count_points"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    timings = {}
    for name in HEADLINE:
        once = lambda name=name: REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(1 + RUNS):  # the first one warms up
            started = time.time()
            once()
            runs.append(time.time() - started)
        timings[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "median": round(statistics.median(timings.values()), 3)}))


if __name__ == "__main__":
    main()
