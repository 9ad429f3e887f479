"""Time the headline pipelines on whole tables and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from rolesieve.catalog import queries as registered
from rolesieve.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "canonical_urls", "dedupe_two_stage", "ingest_final", "ingest_funnel", "years_estimated", "skill_doc_freq",
    "enriched", "analysis_soft", "analysis_hard", "market_summary", "trend_snapshot", "keyword_counts",
    "report_filtered", "new_only", "html_text", "ranked_all", "incremental_runs",
)


def main() -> None:
    spark = local_session(CPUS, app="bench", shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up and code generation of the shared functions are not what is measured.
    registered.canonical_urls(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        getattr(registered, name)(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
