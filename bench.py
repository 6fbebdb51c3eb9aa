"""Times the headline queries and prints one JSON line.

Each query is built and fully computed (a no-op write), after one small warm-up scan.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfwatch.queries import all_queries  # noqa: E402
from shelfwatch.session import local_session  # noqa: E402

HEADLINE = [
    "content_counts", "u06_page_pattern", "u08_search_urls", "u14_resolved_links",
    "k01_content_verdict", "k07_vendor_labels", "k08_block_reasons", "k12_shared_verdicts",
    "a01_attempt_stats", "a04_site_metrics", "a05_pacing", "a10_site_report",
    "w1_recent_by_url", "w2_rolling_times", "w4_failure_digest", "w6_task_ledger", "w8_attempt_positions",
    "j4_cached_levels", "j5_initial_levels",
    "e01_json_ld", "e02_template_products", "e03_profile_products", "e04_payload_products", "e06_chain_products",
    "v2_deduplicated", "v5_threshold_verdicts", "s06_json_products", "m1_s10_exported_examples", "r6_windowed_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, partitions)
    spark.sparkContext.setLogLevel("ERROR")
    build = all_queries()
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        build[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
