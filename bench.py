"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from webcairn.session import local_session

HEADLINE = (
    "documents",
    "documents_chosen",
    "document_errors",
    "inventory",
    "page_rows",
    "page_links",
    "url_canonical",
    "robots_rules",
    "sitemap_budget",
    "link_walk",
    "frontier_admit",
    "change_set",
    "page_upsert",
    "cadence_fold",
    "run_progress",
    "request_admission",
    "version_diff",
    "version_line_delta",
    "log_redaction",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    from webcairn.catalog.registry import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not a query
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": int(os.environ.get("BENCH_CPUS", "8")),
            }
        )
    )


if __name__ == "__main__":
    main()
