"""Headline queries, timed.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 BENCH_RUNS=3 python bench.py

The given tables are single files with one row group, which one task would read alone.
They are dealt to several files first, outside the timed part, as tables of a cluster are.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from tagworth.plans import QUERIES
from tagworth.plans.fixtures import TABLES
from tagworth.plans.q_pricing import items
from tagworth.operators import pricing
from tagworth.session import local_session

HEADLINE = [
    "market_prices",
    "market_prices_approx",
    "headline_price",
    "dedupe_canonical",
    "route_kept",
    "two_buckets",
    "keep_range",
    "next_crawl_batch",
    "merge_by_link",
    "parse_price",
    "title_ngrams",
    "keyword_profile",
    "visual_rank",
    "visible_text",
    "failure_streaks",
    "soft_block_flags",
    "search_results",
    "candidate_rank",
    "extract_listings",
    "log_metrics_stream",
]


def _approx(spark, sf_dir):
    return pricing.market_prices(items(spark, sf_dir), approx=True)


def dealt(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables with several files each."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    table = {**QUERIES, "market_prices_approx": _approx}
    times: dict[str, float] = {}
    copy = dealt(spark, sf_dir, spark.sparkContext.defaultParallelism)
    for name in names:
        took = []
        for i in range(runs + 1):  # the first run warms up
            start = time.time()
            table[name](spark, copy).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.time() - start)
        times[name] = round(statistics.median(took), 3)
    shutil.rmtree(copy)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
