"""Headline queries on one machine. Prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8). Each query runs once after a
short warm-up of the JVM on the same tables; its result is fully computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

QUERIES = [
    "user_day_features",
    "sampling_audit",
    "chronological_event_split",
    "user_disjoint_split",
    "user_day_metrics",
    "event_metrics",
    "edge_stream",
    "sequence_surprise",
    "token_sequences",
    "host_day_dominant_user",
    "interval_label_join",
    "linear_domain_gap",
    "domain_manifest",
    "detect_logistic",
    "detect_random_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or QUERIES

    from daymark.queries import QUERIES as registered, load_all
    from daymark.session import get_spark

    spark = get_spark("bench", cores=cpus, shuffle=max(8, int(cpus)))
    load_all()
    registered["domain_manifest"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
