"""Wall-clock of the headline queries. Prints one JSON line.

BENCH_SF_DIR: folder of the Parquet tables. BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from wardlens.plans.catalog import QUERIES
from wardlens.session import local_session

HEADLINE = [
    "cohort_progression_summary",
    "positive_notes",
    "negative_notes",
    "eda_prefix_prevalence",
    "window_summary",
    "window_percentiles",
    "admission_flags",
    "patient_documents",
    "clean_tokens",
    "clean_clinical",
    "clean_for_embedding",
    "tfidf_weights",
    "bag_of_words",
    "hotspot_counts",
    "hotspot_fuzzy",
    "stay_days",
    "average_embedding",
    "scaled_matrix",
    "augmented_documents",
    "encoded_documents",
    "extension_tokens",
    "classification_report",
    "word_count_histogram",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    # the first job pays for starting the engine, not for a query
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(found.group(1)) if found else None,
    }))


if __name__ == "__main__":
    main()
