"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("chunk_char_window_overlap", "chunk_recursive", "sections_headed", "bm25_vocab",
            "bm25_doc_weights", "search_sparse_topk", "search_dense_topk", "search_hybrid_rrf",
            "multi_query_rrf", "recall_rollup_by_k", "recall_coverage", "score_rollup", "compare_diff")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    from recalloom.plans.queries import QUERIES
    from recalloom.session import local_session

    spark = local_session(cpus, "bench", spark__sql__shuffle__partitions=cpus)
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        # The noop sink computes every row and column without collecting them.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(min(run(name) for _ in range(2)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
