"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is run to completion with the no-op sink (full computation, no
collect). A warm-up pass over the smallest scale factor runs first so JIT and
Python-worker start-up are not charged to the first query. The shared
document index is built once and timed on its own (``index_build``), as an
index would be in production.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "rank_bm25", "multi_ranker", "topk", "search_must", "search_phrase", "rank_cosine_tfidf",
    "rank_word_embeddings", "knn_exact", "lsh_search", "lsh_banded", "minhash_sketch",
    "more_like_this", "suggest_prefix", "suggest_ngram", "build_vocab", "detect_language",
    "nextline_examples", "count_window",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    from quarry.plans import queries
    from quarry.plans.common import doc_index
    from quarry.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="quarry-bench")
    qs = queries()
    names = [n for n in HEADLINE if n in qs]

    def run(name, d):
        t = time.time()
        qs[name](spark, d).write.format("noop").mode("overwrite").save()
        return time.time() - t

    if os.path.isdir(warm_dir) and warm_dir != sf_dir:
        for n in names:
            run(n, warm_dir)

    t = time.time()
    idx = doc_index(spark, sf_dir)
    idx.postings.count()
    idx.term_stats.count()
    idx.stats()
    times = {"index_build": round(time.time() - t, 3)}
    for n in names:
        times[n] = round(run(n, sf_dir), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
