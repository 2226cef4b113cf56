"""Daily price states: exact for small groups, within the rank error for large ones, and read by day."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tagworth.operators import price_states as ps
from tagworth.operators.pricing import market_prices, price_levels
from tagworth.streaming.run import shared_dir

SITES = ("rebag", "jolicloset", "popchill", "unlisted")


def items(spark, n, seed=1, analyses=3):
    rng = random.Random(seed)
    rows = [
        (f"a{rng.randrange(analyses)}", rng.choice(SITES), f"https://x.com/{i}", rng.choice(["Sold", "Available", "?"]), rng.choice([None, round(rng.lognormvariate(6, 0.6), 2)]), rng.randrange(5))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "analysis_id string, site string, url string, status string, price double, day int")


def close(got, want):
    """Equal keys, counts and medians, means within a thousandth."""
    key = lambda r: (r.analysis_id, r.status_kind)
    got, want = {key(r): r for r in got.collect()}, {key(r): r for r in want.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g.raw_median_usd, g.count_items, g.count_priced, g.rank3_guard_reason, g.rank_weights) == (w.raw_median_usd, w.count_items, w.count_priced, w.rank3_guard_reason, w.rank_weights)
        assert g.market_price_usd == pytest.approx(w.market_price_usd, rel=2e-3)
    return len(got)


def test_small_groups_are_exact(spark):
    rows = items(spark, 900)
    assert close(ps.market_prices_of_states(ps.price_states(rows)), market_prices(rows)) == 6
    assert ps.market_prices_of_states(ps.price_states(rows.limit(0))).count() == 0


def test_large_groups_keep_the_rank_error(spark):
    rows = items(spark, 60_000, analyses=1)
    exact = {(r.level, r.status_kind, r.tier): r for r in price_levels(rows).collect()}
    got = {(r.level, r.status_kind, r.tier): r for r in ps.state_levels(ps.price_states(rows)).collect()}
    assert exact.keys() == got.keys() and ps.rank_error() < 0.01
    priced = rows.where("price > 0").select(F.round("price", 2).alias("p"))
    n = priced.count()
    median = got["all", None, None].median_usd
    assert abs(priced.where(F.col("p") <= median).count() / n - 0.5) < 0.01
    for key, r in exact.items():
        g = got[key]
        assert (g.count_items, g["count"]) == (r.count_items, r["count"])
        assert g.median_usd == pytest.approx(r.median_usd, rel=0.03) and g.price_usd == pytest.approx(r.price_usd, rel=0.03)


def test_a_new_day_reads_that_day_only(spark):
    rows, path = items(spark, 600, seed=2), shared_dir(spark)
    ps.write_states(rows.where("day < 3"), path)
    first = {f: None for f in spark.read.parquet(path).inputFiles()}
    ps.write_states(rows.where("day >= 3"), path)
    ps.write_states(rows.where("day = 4"), path)  # a day that runs again replaces itself
    states = spark.read.parquet(path)
    assert set(first) <= set(states.inputFiles())
    assert close(ps.market_prices_of_states(states), market_prices(rows)) == 6
    week = states.where("day IN (1, 2)")
    assert close(ps.market_prices_of_states(week), market_prices(rows.where("day IN (1, 2)"))) == 6
