"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lakewarden.plans import io_queries  # noqa: F401
from lakewarden.plans.queries import QUERIES, TEXT_PARTITIONS
from lakewarden.session import local_session

HEADLINE = [
    "star_findings",
    "star_quality_report",
    "retail_findings",
    "retail_quality_report",
    "profile_columns_lineitem",
    "profile_tables",
    "key_duplicates_lineitem",
    "order_total_accuracy",
    "mdm_exact_documents",
    "golden_part",
    "fuzzy_clusters_part",
    "mdm_clientes",
    "catalog_entries",
    "kpis_by_key",
    "chunks_windows",
    "chunks_recursive",
    "hash_embedding",
    "topk_chunks",
    "topk_vectors",
    "reference_hits",
    "answers",
    "report_lines_full",
    "expanded_context",
    "normalize_text_docs",
    "csv_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    settings = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")}
    if cores.isdigit():  # the given documents are one file of one row group
        settings[TEXT_PARTITIONS] = cores
    spark = local_session(cores, "bench", **settings)
    # one run of a query that is not counted: code is loaded and compiled
    QUERIES["retail_findings"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
