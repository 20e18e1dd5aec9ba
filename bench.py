"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gaugeweave.checks.registry import queries  # noqa: E402
from gaugeweave.session import local_session  # noqa: E402

HEADLINE = (
    "a2_snapshot_pivot",
    "a10_first_per_second",
    "b2_adjacent_pairs",
    "b2_adjacent_pairs_step_column",
    "b8_sample_view",
    "b9_param_change",
    "c1_hour_rollup_mean",
    "c3_hour_rollup",
    "c4_day_rollup",
    "c7_backfill",
    "c9_ten_minute_average",
    "c10_profile_24_7",
    "d4_gap_filled_ten_minutes",
    "f_report_all_metrics",
    "f_report_day_all_metrics",
    "g5_payload_quantised",
    "h1_evaluate",
    "h4_episodes",
    "h9_notifications",
    "j2_stream_delta",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def seconds(query, spark, sf_dir: str) -> float:
    """Plan, run and drain a query without bringing rows to the driver."""
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=max(int(cores), 1))
    known, times = queries(), {}
    for name in HEADLINE:
        seconds(known[name], spark, sf_dir)  # the first run compiles
        times[name] = round(statistics.median(seconds(known[name], spark, sf_dir) for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
