"""Headline timings: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerloom.plans import catalog
from ledgerloom.session import build_session

HEADLINE = [
    "dq1_reject_reasons", "dq10_quality_report", "co5_nearest_window", "co13_ranked_leads", "fe7_counterparties",
    "fe_all_wallet_features", "re4_population_baseline", "bp5_amount_profile", "bp6_tempo_profile", "gr6_degree",
    "qs10_hourly_volume",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        started = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
