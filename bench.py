"""Headline queries on $BENCH_SF_DIR; prints one JSON line.

Results go to a no-op sink: all of every result is computed, none is collected.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import registry  # noqa: E402
from reqlens.session import local_session  # noqa: E402

HEADLINE = [
    "window_counts", "window_counts_hot", "session_distinct", "rate_state", "policy_breaches",
    "feature_vector", "feature_vector_pages", "char_ratios", "body_entropy", "canonical_payload",
    "rule_scan", "rule_severity", "decision_cascade", "labelled_rows", "endpoint_baseline",
    "baseline_join", "latency_summary", "latency_sketch", "traffic_stats", "headline",
    "traffic_series", "recent_events", "roc_auc", "average_precision", "pick_threshold",
    "score_distribution", "family_recall", "seed_summary", "standardise", "iforest_scores",
    "autoencoder_scores", "stream_rate_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    registry.load_all()
    spark = local_session(cores, app="bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
