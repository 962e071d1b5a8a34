"""Time the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` names the folder of Parquet tables, ``BENCH_CPUS`` the number of local cores.
``BENCH_ALL=1`` times every registered query instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from footfall.registry import QUERIES
from footfall.session import build_session

HEADLINE = (
    "session_rollup",
    "session_histogram",
    "session_sample",
    "category_counts",
    "top10_category",
    "top10_session_per_category",
    "page_convert_rate",
    "area_product_counts",
    "area_top3_product",
    "active_top10_visits",
    "active_top10_spend",
    "active_growth_visits",
    "active_growth_spend",
    "first7d_visits",
    "first7d_spend",
    "ad_blacklist",
    "ad_blacklist_filter",
    "ad_stat",
    "ad_province_top3",
    "ad_click_trend",
    "ad_sliding_hour",
    "ad_log_parse",
    "action_log_json",
)

# Live pipelines, timed once and reported apart from the total.
LIVE = ("stream_user_counts", "stream_ad_stat", "stream_click_trend", "stream_sliding_hour")


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else list(HEADLINE)
    cold, warm = {}, {}
    for name in names:

        def run(query=QUERIES[name]) -> None:
            query(spark, folder).write.format("noop").mode("overwrite").save()

        cold[name] = round(seconds(run), 3)
        warm[name] = round(min(seconds(run) for _ in range(2)), 3)
    live = {
        name: round(seconds(lambda query=QUERIES[name]: query(spark, folder).write.format("noop").mode("overwrite").save()), 3)
        for name in LIVE
    }
    spark.stop()
    report = {
        "metric": "headline_queries_warm_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "live": live,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    sys.stdout.write(json.dumps(report) + "\n")


if __name__ == "__main__":
    main()
