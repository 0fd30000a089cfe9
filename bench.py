"""Headline-query timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full into the ``noop`` sink (no driver collect), so the
time covers scan, shuffles and the final stage.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shopflow.plans import registry  # noqa: E402
from shopflow.session import build_session  # noqa: E402

HEADLINE = [
    "basket_pairs", "fbt_topk", "copurchase_topk", "user_collaborative", "latest_basket",
    "search_stats_p95", "latency_percentiles", "health_score", "sessions_feedback",
    "substring_search_page", "facets_matched", "fuzzy_suggest", "consolidated_search",
    "rule_violations", "field_coverage", "feed_transform", "bm25_search", "knn_items", "product_hybrid",
    "hybrid_search", "windowed_stats_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("shopflow-bench", cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", int(cpus) * 2)))
    registry.load_all()
    names = [n for n in HEADLINE if n in registry.QUERIES]
    r = spark.range(1000)
    r.groupBy((r.id % 7).alias("k")).count().collect()  # JVM warm-up
    times, errors = {}, {}
    for n in names:
        t0 = time.time()
        try:
            registry.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            times[n] = None
            errors[n] = str(e)[:300]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total", "value": round(sum(v for v in times.values() if v), 3),
           "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
