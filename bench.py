"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads.
"""

from __future__ import annotations

import json
import os
import re
import time

from tracelode.plans import QUERIES
from tracelode.plans.registry import tables
from tracelode.session import local_session

HEADLINE = [
    "fn_chunk", "join_visible_chain", "join_embedding_projection", "top_dense_exact", "top_dense_ann", "top_bm25",
    "top_lexical_simple", "top_hybrid", "eval_compare", "agg_term_stats", "agg_workflow_summary", "agg_latency",
    "join_char_overlap", "join_rect_overlap", "gr_active_path", "dq_embedding_drift", "win_positions", "st_job_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    started = time.perf_counter()
    t = tables(spark, folder)
    for name in (
        "v_unit", "v_locator", "v_embedding", "v_visible", "v_dense", "v_slots", "v_postings", "v_runs", "v_vector_slots", "v_vector_blocks",
    ):
        t(name)
    times["build_corpus"] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(found.group(1)) if found else folder,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
