"""Time the headline queries on local cores; one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times (default 3) into
a sink that computes every row and stores nothing; the median counts.
``python bench.py --all`` times every registered query, ``--literal`` also the
window-function form of the latest-row and latest-cycle reports. Names of
queries restrict the run to them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.catalog.queries import QUERIES
from fleetlens.sources.fixtures import Fixtures
from tests.session import make_session

HEADLINE = [
    "report_instance_vitals",
    "report_data_lag",
    "report_ag_sync_status",
    "report_backup_health",
    "report_active_queries",
    "report_table_health",
    "report_wait_delta",
    "report_growth_daily",
    "report_growth_keys",
    "report_stale_tables",
    "report_job_failures",
    "forecast_disk_full",
    "detect_cost_anomaly",
    "generate_findings",
    "evaluate_alerts",
    "report_estate_health",
    "report_overview",
    "extract_query_cost",
    "extract_lock_waits",
    "extract_top_queries",
]


def _window_row(frame, keys):
    w = Window.partitionBy(*keys).orderBy(F.desc("CollectedAt"), F.desc("SnapshotID"))
    return frame.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")


def _window_cycle(frame, keys):
    w = Window.partitionBy(*keys).orderBy(F.desc("CollectedAt"))
    return frame.withColumn("_rn", F.dense_rank().over(w)).filter("_rn = 1")


LITERAL = {
    "report_instance_vitals": lambda f: _window_row(f.fx_health_metric, ["Platform", "ServerName", "MetricName"]),
    "report_data_lag": lambda f: _window_row(f.fx_data_lag, ["Platform", "ServerName", "ObjectName", "Metric"]),
    "report_ag_sync_status": lambda f: _window_row(f.fx_ag, ["AGName", "DatabaseName", "ReplicaServer"]),
    "report_active_queries": lambda f: _window_cycle(f.fx_query_snapshot, ["Platform", "ServerName"]),
    "report_table_health": lambda f: _window_cycle(f.fx_table_health, ["ServerName"]),
}


def timed(build, runs: int) -> float:
    took = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    return round(statistics.median(took[1:] or took), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = make_session(cpus, os.environ.get("BENCH_MEMORY", "12g"))
    named = [a for a in sys.argv[1:] if not a.startswith("--")]
    names = named or (list(QUERIES) if "--all" in sys.argv else HEADLINE)
    took = {n: timed(lambda n=n: QUERIES[n](spark, sf_dir), runs) for n in names}
    out = {
        "metric": f"sum of median query times over {len(took)} queries",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }
    if "--literal" in sys.argv:
        out["literal"] = {n: timed(lambda b=b: b(Fixtures(spark, sf_dir)), runs) for n, b in LITERAL.items()}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
