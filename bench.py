"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once to warm up and then BENCH_RUNS times (default 2); the median
counts. Every run writes all result rows to a sink that drops them. The inventory
table that the queries share is written once to warm up and once more as `ingest`.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries as q  # noqa: E402
from checks.session import local_session  # noqa: E402
from treeline.plans import sample_inventory as sample  # noqa: E402

HEADLINE = [
    q.inventory_dirs, q.duplicate_kinds, q.mark_duplicates, q.effective_decision,
    q.effective_review_and_decision, q.delete_manifest, q.manifest_guard, q.subtree_candidates,
    q.triage_batches, q.triage_apply, q.summarize_eligible, q.truncate_words, q.pdf_complexity,
    q.sheet_text, q.copy_plan, q.duplicates_report,
]


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session()
    sample.conformed(spark, folder)
    start = time.perf_counter()
    sample.ingest(spark, folder)
    times = {"ingest": round(time.perf_counter() - start, 3)}
    for query in HEADLINE:
        run(query, spark, folder)
        times[query.__name__] = round(
            statistics.median(run(query, spark, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
