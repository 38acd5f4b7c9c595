"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed, none
sent to the driver). Before timing, every headline query runs once on the
sf0.001 tables (JVM/JIT warm-up, not timed; BENCH_WARMUP=0 skips it), so the
numbers are steady-state times on the measured data. Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
Set BENCH_EVENT_LOG=1 to write Spark's event log to a fresh scratch folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feature_table",      # flagship: entity features x as-of team standings
    "entity_features",
    "team_features",
    "league_table",
    "asof_events",
    "upsert_keep_last",
    "describe_numeric",
    "anova_f",
    "corr_matrix",
    "hash_split",
    "fit_linear",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # partition sizing for this machine: AQE coalesces shuffle partitions to this size
    extra = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": os.environ.get("BENCH_ADVISORY_BYTES", "16m")}
    if os.environ.get("BENCH_EVENT_LOG"):
        d = tempfile.mkdtemp(prefix="bench-events-")
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": d})
    from panelspark import registry
    from panelspark.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if str(cpus).isdigit() else 16,
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"), extra=extra)
    registry.load_all()
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") != "0" and os.path.isdir(warm):
        for n in names:
            registry.QUERIES[n](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        registry.QUERIES[n](spark, root).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", root)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else root}))
    spark.stop()


if __name__ == "__main__":
    main()
