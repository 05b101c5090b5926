"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from fragloom.plans import catalog
from fragloom.plans.registry import forget
from fragloom.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "fragment_census", "carve_blocks", "content_dedup", "reassemble", "byte_features", "rule_label", "classify_block", "token_jaccard",
    "adjacent_pairs", "top_edges_per_node", "ground_refs", "group_gaps", "canonical_json", "reading_order_bands", "rebuild_table",
]


def main() -> None:
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "12g"))
    spark.read.parquet(f"{FOLDER}/documents.parquet").count()  # session warm-up, no query work
    times: dict[str, float] = {}
    for name in HEADLINE:
        forget()
        start = time.perf_counter()
        catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(FOLDER).removeprefix("sf")}))


if __name__ == "__main__":
    main()
