"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the test tables, BENCH_CPUS: cores of the local session,
BENCH_QUERIES: optional comma-separated names ('all' for every query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from labelloom.plans import registry
from labelloom.session import build_session

HEADLINE = [
    "reliability", "greedy_match_truth", "fidelity", "peer_consensus", "geometry_audit", "confusion_counts",
    "cluster_boxes", "fuse_labels", "gate_objects", "assemble_items", "union_area", "nms", "submission_fingerprints",
    "near_duplicates", "compose_rewards", "shape_incentives", "leaderboard", "ema", "hash_split", "cluster_points",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    names = os.environ.get("BENCH_QUERIES", "")
    chosen = list(registry.QUERIES) if names == "all" else names.split(",") if names else HEADLINE
    spark.read.parquet(f"{path}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.time()
        registry.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(path.rstrip("/"))}))


if __name__ == "__main__":
    main()
