"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioweave.plans import catalog
from folioweave.session import local_session

HEADLINE = [
    "b09_user_item_cf", "b06_action_bigrams", "b08_peer_trending", "b15_decayed_profile", "b19_daily_digest",
    "t04_cleaning_summary", "t10_language", "t15_redaction_report", "h02_hierarchy", "h03_canonical_refs",
    "c04_article_chunks", "c06_flat_chunks", "r08_multi_pass_search", "r13_vector_top_k", "r15_signal_fusion",
    "g13_graph_stats", "v02_bounded_expansion", "e05_coverage", "q03_check_suite", "x03_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    registered = catalog.all_queries()
    # start the JVM code paths and the Python workers outside the timings
    registered["a01_count_by_key_top"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
