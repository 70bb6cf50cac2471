"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose the data, the cores and the number of
timed runs after one warm-up. Each result is forced through a `noop` write.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from rolesift.plans.queries import QUERIES
from rolesift.session import build_session

HEADLINES = (
    "keyword_score",
    "keyword_matches_table",
    "keyword_lift",
    "html_text",
    "url_endpoints",
    "location_filter",
    "first_per_key",
    "pages_until_stop",
    "join_details",
    "jobs_with_company",
    "insert_new",
    "assign_ids",
    "upsert",
    "update_by_id",
    "delete_cascade",
    "first_decision",
    "ingest_boards_jobs",
    "ingest_pages_jobs",
)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in names or HEADLINES:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main(sys.argv[1:])
