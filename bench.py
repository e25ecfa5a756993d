"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from estatelens import queries as core

HEADLINE = ["probe_lineitem_orders", "profile_columns_orders", "profile_columns_part", "discover_relationships", "key_pattern_customer_name", "tokenize_documents", "bm25_documents", "vector_topk", "rrf_hybrid", "object_rollup", "lexical_search_catalog", "schema_changes", "upstream_trace", "table_lineage", "runtime_closure", "knowledge_budget", "network_edges", "trace_hops", "item_violations", "event_violations", "review_lineage", "refreshed_counts", "refreshed_lineage_counts", "retrieval_documents", "postings_search_many", "workspace_search_bm25", "write_markers", "write_units_proposed", "closure_calls"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = core.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first compiles
            began = time.time()
            known[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, sum of medians of three warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
