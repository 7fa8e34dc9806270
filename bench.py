"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query is run twice into a sink that keeps nothing; the faster run counts, so JVM warm-up does
not. ``per_search_ms`` divides a retrieval run by the number of queries it answers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lodestone import build_session
from lodestone.registry import QUERIES

HEADLINE = [
    "vector_topk",
    "vector_search",
    "batch_vector_search",
    "bm25_corpus",
    "bm25_candidates",
    "hybrid_search",
    "citations",
    "idf",
    "tokenize",
    "filter_required_phrases",
    "markdown_sections",
    "chunk_text",
    "embed_chunks",
    "html_links",
    "capture_lint",
    "extract_date",
    "changed_documents",
    "upsert_documents",
    "decision_matches",
    "extract_decisions",
    "supersession_chain",
    "search_hit_rate",
    "stale_document_buckets",
    "failure_signals",
    "fix_queue",
    "coach_suggestions",
    "eval_run",
    "stream_hit_rate",
    "stream_feedback_sessions",
]
SEARCHES = ["batch_vector_search", "bm25_corpus", "hybrid_search"]


def timed(spark, name: str, sf: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    for name in ("vector_topk", "batch_vector_search"):  # JVM, code generation and Python workers
        timed(spark, name, sf)
    times = {}
    for name in names:
        times[name] = round(min(timed(spark, name, sf) for _ in range(2)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    per_search = {n: round(1000 * times[n] / asked, 2) for n in SEARCHES if n in times}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "per_search_ms": per_search,
                "sf": sf.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
