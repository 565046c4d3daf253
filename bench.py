"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from kinweave.plans import registry
from kinweave.session import build_session

HEADLINE = [
    "recommend_end_to_end", "coauthor_distance", "author_capability_agg", "capability_evidence_join",
    "project_domains_with_ancestors", "authors_extracted", "canonical_table_counts", "issue_counts",
    "quality_homonyms", "integrity_relationship_multiplicity", "resolve_embedding", "normalize_text", "leave_one_out_eval",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = registry.queries()
    # One small query first, so that no headline number holds the start of the virtual machine.
    chosen["project_page"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        chosen[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
