"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from basketry.plans import load_catalog
from basketry.session import build_session

HEADLINE = [
    "e02_customer_features",
    "e05_event_features",
    "e07_daily_sales",
    "e11_top_products",
    "e14_geo_sales",
    "e26_product_quality_mart",
    "customer_rfm_abc",
    "f02_rfm_segments",
    "f06_product_abc_xyz",
    "b12_winsorise",
    "b13_drop_duplicates",
    "c03_describe_numbers",
    "d10_review_features",
    "g14_snapshot_panel",
    "g19_binary_metrics",
    "h02_retention_offers",
    "h07_interactions",
    "h11_holdout_metrics",
    "i03_daily_model_table",
    "i05_weekly_model_by_state",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus) if cpus.isdigit() else 8,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_catalog().QUERIES
    queries["e07_daily_sales"](spark, folder).write.format("noop").mode("overwrite").save()  # start the engine
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
