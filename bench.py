"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the tables      (default /root/testdata/sf0.1)
BENCH_CPUS    local cores               (default 8)
BENCH_RUNS    timed runs, best counts   (default 2; the first also warms up)
BENCH_ALL     set to time every registered query
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lorekeep.plans.catalog import QUERIES  # noqa: E402
from lorekeep.session import local_session  # noqa: E402

HEADLINE = [
    "html_clean",
    "html_blocks",
    "link_resolve",
    "size_gate",
    "chunk_hybrid",
    "chunk_index",
    "chunk_report",
    "embed_chunks",
    "kb_search_batch",
    "kb_search_text",
    "keyword_search",
    "source_upsert",
    "crawl_reachable",
    "events_last_n",
    "event_replay",
    "entries_append",
    "load_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cpus)
    taken = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        taken[name] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
