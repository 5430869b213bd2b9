"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], one JSON line.

Each query is run once to warm up and then timed ``BENCH_RUNS`` times; the
median counts.  Results are computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pairforge.checks.queries import QUERIES
from pairforge.session import local_session

HEADLINE = (
    "q_norm_sts",
    "q_norm_triples",
    "q_norm_passages",
    "q_norm_bitext",
    "q_validate_errors",
    "q_unique_texts",
    "q_cap_examples",
    "q_split_shard",
    "q_query_prompted",
    "q_build_corpus",
    "q_encode_texts",
    "q_mean_pool",
    "q_vector_lookup",
    "q_batches",
    "q_positive_pairs",
    "q_loss_bundle",
    "q_pairwise_cosine",
    "q_sts_spearman",
    "q_retrieval_eval",
    "q_eval_report",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "pairforge-bench")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rpartition("sf")[2],
            }
        )
    )


if __name__ == "__main__":
    main()
