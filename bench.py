"""Benchmark: run the registered queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (no driver collect)
and timed with a wall clock.  All queries run twice: the first (cold) pass
pays one-time code generation and JIT; the second (warm) pass is the reported
value, the cold pass is included as ``cold_total`` / ``cold_queries``.  The
whole run prints ONE JSON line:
{"metric": "total_query_seconds_warm", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Model training queries (bench=False) are left out: they measure the GBT
trainer, not the query engine.  Set BENCH_QUERIES to a comma list of name
substrings to run a subset.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [s for s in os.environ.get("BENCH_QUERIES", "").split(",") if s]

    from meterframe.plans.registry import all_queries
    from meterframe.session import build_session

    spark = build_session(
        f"local[{cpus}]",
        app="meterframe-bench",
        conf={
            "spark.sql.shuffle.partitions": os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(int(cpus), 1) * 2)),
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
        },
    )
    queries = {n: q for n, q in all_queries().items() if q.bench and (not only or any(s in n for s in only))}
    # The table build runs first: every dashboard query then scans the stored
    # table, as the source's queries scan its stored table.
    build = all_queries()["a00_sales_build"]
    queries = {"a00_sales_build": build, **{n: q for n, q in queries.items() if n != "a00_sales_build"}}

    # Warm-up on the smallest table: JVM start-up and JIT, not timed.
    spark.read.parquet(os.path.join(sf_dir, "nation.parquet")).groupBy("n_regionkey").count().write.format("noop").mode("overwrite").save()

    def run_all():
        times, failed = {}, {}
        for name, q in queries.items():
            t0 = time.perf_counter()
            try:
                q.spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
                times[name] = round(time.perf_counter() - t0, 3)
            except Exception as e:  # noqa: BLE001 - report and keep benchmarking
                failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        return times, failed

    # Pass 1 (cold: first-time code generation and JIT), pass 2 (warm) is reported.
    cold, _ = run_all()
    times, failed = run_all()
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds_warm",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "n_queries": len(times),
        "cold_total": round(sum(cold.values()), 3),
        "cold_queries": cold,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
