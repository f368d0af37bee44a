"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores),
BENCH_QUERIES (comma separated, default: the headline set).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pitsignal.plans.registry import all_queries
from pitsignal.session import get_session

HEADLINE = (
    "pit_features_events", "pit_features_as_of", "contributing_signals", "extract_signals", "document_cues",
    "contract_errors", "reversal_links", "ledger_as_of", "ledger_append", "historical_features", "latest_features",
    "oracle_features", "shuffled_features", "weekly_demand", "tabular_features", "forecast_arms", "arm_metrics",
    "classification_report", "field_metrics", "duplicate_text_leakage",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 1)
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = get_session("pitsignal-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    # Start the JVM's compiler and the Python workers outside the timings.
    queries["corpus_summary"](spark, sf_dir).collect()
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
