"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores. Each query is
materialised in full with the ``noop`` sink: one cold run, then warm runs, of
which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paystrata.catalog import queries  # noqa: E402
from paystrata.session import local_session  # noqa: E402
from paystrata.sources.staging import staging_scope  # noqa: E402

HEADLINE = [
    "monthly_summary", "department_summary", "payroll_history", "payroll_history_detail",
    "audit_search_date_range", "dashboard_kpis", "department_trends", "employee_payroll_ranking",
    "employee_payroll_analytics", "fact_payroll", "data_mart_dept_summary", "run_payroll",
    "merge_payroll", "update_employees", "add_employees",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    warm_runs = int(os.environ.get("BENCH_WARM_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="paystrata-bench")
    registered = queries()

    def once(name: str) -> float:
        begun = time.perf_counter()
        with staging_scope(spark):
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begun
        return took

    once("monthly_summary")  # starts the executor threads and the code generator
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(once(name), 3)
        warm[name] = round(statistics.median(once(name) for _ in range(warm_runs)), 3)
    print(json.dumps({
        "metric": "headline queries, warm median, total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": cores, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
