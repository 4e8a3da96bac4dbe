"""Times the headline queries on local cores and prints one JSON line.

Each query is run once to warm up (class loading, code generation) and then timed once, writing every
row to the no-op sink. The test tables are files of one row group, which can't be split, so the benchmark asks
for their rows in one partition per core; without that setting tables are read as they lie.
"""

from __future__ import annotations

import json
import os
import time

from pagewright.plans.queries import QUERIES
from pagewright.session import build_session
from pagewright.sources.snapshot import READ_PARTITIONS

HEADLINE = (
    "url_routing", "url_skip", "url_normalize_dedup", "response_routing", "private_ip", "url_safety", "fetch_outcome", "page_links",
    "page_metadata", "page_text", "page_markdown", "crawl_bfs", "chunk_pack", "prompt_table", "admission_verdicts", "signed_plan",
    "token_bucket", "reject_throttle", "usage_rollup", "queue_trim", "job_latest_status", "queue_health",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(f"local[{cpus}]", cpus, **{"spark.driver.memory": "16g", "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false", READ_PARTITIONS: str(cpus)})
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
