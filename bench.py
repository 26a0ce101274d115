"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. Arguments, if any, choose queries
("all" for every one). Each result is fully produced and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citeframe.plans.registry import QUERIES  # noqa: E402
from citeframe.session import local_session  # noqa: E402

HEADLINE = [
    "catalog_document", "constraint_profile", "eligibility_join", "eligibility_counts", "true_negatives",
    "named_match", "idf_table", "tfidf_norms", "tfidf_topk", "dense_cosine_topk", "retrieve_topk",
    "retrieve_exhaustive", "context_block", "response_validate", "citation_check", "redact_all",
    "log_roundtrip", "cost_by_model", "eval_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or HEADLINE
    if chosen == ["all"]:
        chosen = list(QUERIES)
    spark = local_session(cores, partitions=max(cores, 8))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
