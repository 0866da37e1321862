"""Benchmark: run the headline queries and print ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list to override the headline set).
Each query is built (including its eager fit steps) and fully executed into the
``noop`` sink, so the time covers all the work without collecting to the driver.
Each query runs BENCH_RUNS times (default 2) and the best time is reported: the
first run of a code path pays JVM JIT warm-up, which dominates at small scale.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "prepared_features", "step_split", "hmac_tokens", "psi_intersect", "psi_semi_filter",
    "stratified_split", "rank_to_prob", "per_client_metrics", "micro_metrics", "alpha_search",
    "grad_sum", "fedavg_rounds", "dedup_updates", "round_summary", "masked_sum", "mutual_info_binned",
    "stream_windows", "train_lr",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    runs = max(1, int(os.environ.get("BENCH_RUNS", "2")))

    from ledgerlens.plans import QUERIES
    from ledgerlens.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=2 * cpus)
    # warm-up (JIT, first-scan costs) on a small query, not timed
    QUERIES["split_counts"](spark, sf_dir).collect()

    times: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in names:
        best = None
        for k in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if k == 0:
                first[name] = round(dt, 3)
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "runs": runs, "stat": "min", "first_run_total": round(sum(first.values()), 3)}))


if __name__ == "__main__":
    main()
