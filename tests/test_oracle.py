"""Registered queries against independent SQL on the smallest tables.

Every query; TAGWORTH_SHORT=1 runs a short list.
"""

from __future__ import annotations

import os
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

from tagworth.plans import ORACLES, QUERIES  # noqa: E402
from tagworth.plans.check import compare  # noqa: E402
from tagworth.plans.fixtures import TABLES  # noqa: E402

SHORT = [
    "market_prices", "headline_price", "tier_prices", "to_usd_asof", "infer_brand", "two_buckets", "dedupe_canonical",
    "merge_by_link", "keep_range", "candidate_rank", "next_crawl_batch", "resolve_price", "final_status", "parse_price",
    "canonical_key", "condition_norm", "keyword_profile", "score_keywords", "visual_rank", "visual_accept",
    "soft_block_flags", "failure_streaks", "task_status", "nested_results", "near_anchor", "visible_text",
    "log_metrics_stream", "soft_block_holds", "quarantine_stream", "quarantine_states",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SHORT if os.environ.get("TAGWORTH_SHORT") else list(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) == ""


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
