"""Headline queries timed on one machine; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from tidewater.plans import catalogue
from tidewater.session import session

HEADLINE = (
    "feed_page", "participant_rollup", "due_list", "day_runs", "latest_per_key", "report_by_kind", "chunk_assignment", "chunk_context", "sliding_admission", "burst_count",
    "export_round_trip", "parse_report", "content_hash_dedup", "ingest_accounting", "dedup_key", "precision_instant", "absorb_mentions", "event_upsert", "grounding", "label_scores", "token_cost",
)


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    more = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = session("bench", f"local[{cpus}]", **more)
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    names = [n for n in sys.argv[1:] if n in queries] or [n for n in HEADLINE if n in queries]
    queries[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first query would pay for the start
    for name in names:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, the better of two runs each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
