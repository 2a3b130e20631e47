"""Headline queries on one local session; prints one JSON line.

Each query is run to a sink that keeps nothing, so planning, scanning, shuffling and evaluation are timed and result
transport is not.
"""

from __future__ import annotations

import json
import os
import sys
import time

from siteready.session import local_session
from siteready.verify import registry

HEADLINE = ["score_headline", "agg_28_friction_kpis", "win_03_rage", "agg_30_majority_vote", "win_11_sample_cap", "agg_23_network_summary", "win_07_layout_shift", "join_18_as_of_since",
            "join_11_sneak_into_basket", "ora_02_item_under_price", "agg_35_call_quantiles", "txt_01_page_features", "join_17_lexicon_hits", "win_10_select_snippets", "agg_13_noisy_or"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "siteready-bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()  # warm the session
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
