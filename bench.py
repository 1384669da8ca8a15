"""Bench: wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, `all` for every query).
Every query runs to completion into the no-op sink, so all columns are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "lead_time_scores", "monthly_contingency", "leaderboard", "contingency_thresholds", "generalization_gap",
    "basin_best_model", "qq_pairs", "align_models", "qc_status", "completeness_tiers", "longest_gap", "deaccumulate",
    "deaccumulate_6h", "unit_inference", "asof_lookback", "interval_labels", "lag_features", "rolling_cycles",
    "radius_pairs", "ring_stats", "plane_gradient", "nearest_site", "cell_stats", "terrain_slope", "neighbour_smooth",
    "time_split", "standardise", "prediction_export", "feature_matrix", "gbt_l1",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pluvian.session import build_session
    from workload.catalog import all_queries

    spark = build_session("bench", cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    queries["season"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the session's machinery
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
