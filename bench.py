"""Benchmark the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
  {"metric": "full_audit_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

The headline is ``full_run``: all 17 checks through the runner, the way an
audit is run - one rollup of the log and up to four checks as concurrent
Spark jobs. ``checks_total_sec`` is the sum of the 17 checks
timed one by one. Each query is timed end to end - building the DataFrame
from the Parquet tables and collecting its result - after one untimed
warm-up pass (JIT and code generation); the reported time is the median of
BENCH_REPS runs. The first (cold) run of every query is under "cold".
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from workload_audit.config import fixture_config  # noqa: E402
from workload_audit.operators.primitives import OPERATORS  # noqa: E402
from workload_audit.plans.registry import select_checks  # noqa: E402
from workload_audit.plans.runner import run_checks  # noqa: E402
from workload_audit.session import local_session  # noqa: E402
from workload_audit.sources.fixtures import fixture_tables  # noqa: E402

EXTRA_OPERATORS = ("op_quantile_cont", "op_quantile_exact", "op_primary_user")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8), app="workload-audit-bench")
    cfg = fixture_config()

    jobs = {}
    for spec in select_checks():
        jobs[spec.name] = (lambda s=spec: s.fn(fixture_tables(spark, sf_dir), cfg).collect())
    for key in EXTRA_OPERATORS:
        jobs[key] = (lambda k=key: OPERATORS[k](fixture_tables(spark, sf_dir), cfg).collect())
    jobs["full_run"] = lambda: run_checks(fixture_tables(spark, sf_dir), cfg)

    cold, warm = {}, {}
    for name, job in jobs.items():
        t0 = time.perf_counter()
        job()
        cold[name] = round(time.perf_counter() - t0, 3)
    for name, job in jobs.items():
        times = []
        for _ in range(reps):
            t0 = time.perf_counter()
            job()
            times.append(time.perf_counter() - t0)
        warm[name] = round(statistics.median(times), 3)

    checks = [s.name for s in select_checks()]
    total = round(sum(warm[c] for c in checks), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "full_audit_sec",
                "value": warm["full_run"],
                "unit": "sec",
                "checks_total_sec": total,
                "queries": warm,
                "cold": cold,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "reps": reps,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
