"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_RUNS    timed runs per query after one to warm up; the median counts (default 3)

Besides seconds: documents a second, seconds without the render of the input,
and MB written to shuffles in one run.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from billsift.plans.invoices import prepared_invoices
from billsift.plans.queries import queries
from billsift.session import local_session

RENDERED = (
    "extract_record",
    "extract_items",
    "typed_record",
    "reconcile_totals",
    "fraud_bank_account",
    "vendor_baseline",
    "status_summary",
    "structured_build",
    "column_widths",
    "export_records",
)
HEADLINE = RENDERED + (
    "first_by_hash",
    "find_duplicates",
    "append_new",
    "best_candidate",
    "fold_pages",
    "route_short_text",
    "quality_score",
    "redact_text",
)


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


class ShuffleLog:
    """MB that tasks wrote to shuffles since the last look, from the event log."""

    def __init__(self, folder: str):
        self.folder, self.read = Path(folder), 0

    def since(self) -> float:
        time.sleep(0.5)
        total = 0
        for path in self.folder.iterdir():
            with path.open(errors="replace") as log:
                log.seek(self.read)
                while (line := log.readline()).endswith("\n"):
                    self.read = log.tell()
                    if '"SparkListenerTaskEnd"' in line:
                        metrics = json.loads(line).get("Task Metrics") or {}
                        total += metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
        return round(total / 1e6, 1)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    with tempfile.TemporaryDirectory() as events:
        spark = local_session(cpus, partitions=cpus, memory="16g", settings={
            "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{events}",
            "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
            "spark.eventLog.buffer.kb": "1k"})
        log = ShuffleLog(events)
        available = queries()
        documents = prepared_invoices(spark, folder).count()
        jobs = {"render_input": lambda: prepared_invoices(spark, folder)}
        jobs.update({n: (lambda n=n: available[n](spark, folder)) for n in HEADLINE})
        seconds, shuffled = {}, {}
        for name, build in jobs.items():
            log.since()
            timed(build)
            shuffled[name] = log.since()
            seconds[name] = round(statistics.median(timed(build) for _ in range(runs)), 3)
        spark.stop()
    render = seconds["render_input"]
    print(json.dumps({
        "metric": "total time of the headline queries, warm",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
        "documents": documents,
        "without_render": {n: round(seconds[n] - render, 3) for n in RENDERED},
        "documents_per_second": {n: round(documents / seconds[n]) for n in RENDERED},
        "shuffle_mb": shuffled,
    }))


if __name__ == "__main__":
    main()
