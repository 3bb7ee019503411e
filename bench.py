"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans.registry import load
from tidemark.session import build_session

HEADLINES = [
    "prediction_points", "bureau_history_features", "bureau_balance_features", "application_features", "feature_values_long",
    "training_view", "woe_rules", "applied_woe", "population_stability", "ranking_power", "newest_view_before_purchase",
    "content_fingerprint", "bureau_features_at_each_prediction", "composite_key_check", "enriched_balance", "source_events", "valid_envelopes", "snapshot_overwrite",
    "latest_line_per_order", "stream_feature_values", "files_to_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = load()
    names = sys.argv[1:] or HEADLINES
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up is not timed
    seconds = {}
    for name in names:
        started = time.perf_counter()
        # All rows are computed and none reaches the driver.
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
