"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional). Each query is run to completion with
the ``noop`` sink (full computation, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kg_star_text",        # star graphs: top-n per centre + textualisation
    "A8_qa_rows",          # QA rows: spans, answer fan-out, star/label joins
    "E3_graph_edges",      # distinct triples + distributed dense ordinal
    "G9_tool_edges",       # out-else-in edges as an anti-join
    "SP8_shuffled_batches",
    "T13_padded_batches",  # tokenizer offsets, vocabulary, padding
    "N11_tool_results",    # tool-call parse + exact/fuzzy linking
    "M6e_hit_at_k",        # causal shift, ranks, hit@k
    "M18e_best_and_patience",
    "V3_rvq_codes",        # residual quantisation (Arrow batches)
    "L5_link_ranks",       # candidate banks + dot scores
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from trellis.plans.registry import load_all
    from trellis.session import get_spark

    spark = get_spark(cores=cpus)
    reg = load_all()
    # warm the JVM once on the smallest data (not timed)
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        reg["kg_star_text"].fn(spark, warm).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        t0 = time.time()
        reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
