"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed from the parquet files: the stored tables of the previous query are forgotten, so a
query pays for every table it builds.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spreadlens.core.session import local_session  # noqa: E402
from spreadlens.plans import catalog  # noqa: E402
from spreadlens.plans.registry import forget_tables  # noqa: E402

HEADLINE = ["src13_daily_spread_vwap", "st10_rank_by_correlation", "st8_adf", "bar1_trade_bars", "bar4_bars", "jn4_asof",
            "tr4_signed_trades", "bk10_flow_events", "bk15_walk_book", "bk18_episodes", "inf3_vpin_tape", "inf7_hourly_information",
            "inf13_impact_response", "pf9_complete_features", "pf11_samples", "bt18_metrics", "bt22_walk_forward", "inr2_hac_variance",
            "ex3_passive_outcome", "st18_noise_calibration"]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["st2_ols_hedge"](spark, root).count()  # start the JVM and the Python workers
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        forget_tables()
        t0 = time.time()
        catalog.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(root.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
