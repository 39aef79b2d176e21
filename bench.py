"""Times the headline queries: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the timed runs
after one warm-up. Every query is run in full; the result is consumed without a sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sensorloom.plans.catalog import QUERIES  # noqa: E402
from sensorloom.session import build_session  # noqa: E402

HEADLINE = [
    "windowed_sensor_agg",
    "windowed_sensor_agg_30s",
    "approx_sensors",
    "json_flatten",
    "canonical_identity",
    "domain_union",
    "route_topics",
    "dead_letter",
    "latest_per_key",
    "retention_filter",
    "vitals_alerts_strict",
    "alerts_long",
    "alert_rate_by_ward",
    "machine_status",
    "edge_asof_join",
    "temperature_route",
    "traffic_features",
    "burst_probability",
    "rolling_stats",
    "ma_crossover",
    "episode_score",
    "scenario_score",
    "capacity_recommendation",
    "capacity_backlog",
    "latency_percentiles",
    "latency_nearest_rank",
    "summary_stats",
    "value_histogram",
    "improvement_vs_baseline",
    "stream_windowed_agg",
    "stream_features",
    "stream_route",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus),
        {"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        # A stream pays for checkpoints on every run; one timed run is enough.
        timed = 1 if name.startswith("stream_") else runs
        for _ in range(timed + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
