"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "headline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

``ingest`` is the one-off build of the stored order tables (canonical view +
derived columns, written partitioned by month); every other number is the
median of three warm runs of one query, executed fully through the ``noop``
sink (no rows are collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillpoint.plans import frames  # noqa: E402
from tillpoint.plans.catalog import load_all  # noqa: E402
from tillpoint.session import build_session  # noqa: E402

HEADLINE = [
    "p01_channel_date_pivot",
    "p11_heatmap_cells",
    "p04_general_pivot_median",
    "p07_combined_changes",
    "d01_kpis",
    "d02_daily_series",
    "d04_discount_by_brand",
    "d07_discount_range_table",
    "d18_location_brand_scorecard",
    "d03_customer_table",
    "g07_customer_lifetime_value",
    "g09_churn_features",
    "g13_rfm",
    "d29_numeric_profile",
    "b02_extended_columns",
    "a06_clean_landing_export",
]
RUNS = 3


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(cpus, 8))))
    spark = build_session(f"local[{cpus}]", parts, app="tillpoint-bench")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillpoint-bench-"))
    reg = load_all()
    times: dict[str, float] = {}

    t0 = time.perf_counter()
    frames.essential(spark, sf_dir)
    frames.orders(spark, sf_dir)
    times["ingest"] = round(time.perf_counter() - t0, 3)

    for name in HEADLINE:
        q = reg[name]
        run(q.build(spark, sf_dir))  # warm-up
        samples = []
        for _ in range(RUNS):
            t = time.perf_counter()
            run(q.build(spark, sf_dir))
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(v for k, v in times.items() if k != "ingest"), 3)
    print(json.dumps({
        "metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
        "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "shuffle_partitions": parts,
        "runs": RUNS, "statistic": "median of warm runs",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
