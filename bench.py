"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is fully materialised with the ``noop`` sink (all rows computed, nothing collected
to the driver) and timed on its own; the JVM is warmed up first and not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "format_messages", "format_alpaca", "dataset_summary", "quality_gate", "exact_dedup", "near_dup_pairs",
    "near_dup_clusters", "contamination", "length_moments", "chat_structure_check", "quality_label_profile",
    "train_val_split", "seeded_shuffle", "stratified_sample", "corpus_loss", "loss_by_slice", "running_loss",
    "classification_metrics", "rank_runs", "diagnose_runs", "loss_oscillation", "plan_runs",
    "read_dataset_jsonl", "stream_append_prepared", "stream_run_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    os.environ.setdefault("TUNEDATA_MASTER", f"local[{cpus}]")
    from tunedata.plans.registry import load_all
    from tunedata.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    registry = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in registry]
    registry["size_risk"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
