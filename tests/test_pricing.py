"""Hand-computed market prices and independence from input order."""

from __future__ import annotations

import random
import statistics

import pytest

from tagworth.operators.pricing import headline_price, market_prices, raw_medians, tier_prices

T1, T2, T3, NONE = "rebag", "jolicloset", "popchill", "unlisted"


def frame(spark, rows):
    return spark.createDataFrame(
        [("a", s, f"https://{s}.com/{i}", st, p) for i, (s, st, p) in enumerate(rows)],
        "analysis_id string, site string, url string, status string, price double",
    )


def market(spark, rows, kind="available"):
    got = [r for r in market_prices(frame(spark, rows)).collect() if r["status_kind"] == kind]
    return got[0] if got else None


def test_one_price(spark):
    r = market(spark, [(T1, "Available", 100.0)])
    assert (r["market_price_usd"], r["rank_weights"]["rank1"], r["count_items"]) == (100.0, 2.0, 1)


def test_clamps_both_sides(spark):
    rows = [(T1, "Sold", p) for p in (10.0, 100.0, 100.0, 500.0)]
    t = tier_prices(frame(spark, rows)).first()
    assert (t["median_usd"], t["floor_usd"], t["ceiling_usd"]) == (100.0, 70.0, 120.0)
    assert (t["clamped_low_count"], t["clamped_high_count"], t["price_usd"]) == (1, 1, 97.5)


def test_even_count_median(spark):
    assert tier_prices(frame(spark, [(T1, "Sold", 100.0), (T1, "Sold", 110.0)])).first()["median_usd"] == 105.0


def test_tier3_inside_and_outside_the_guard(spark):
    inside = market(spark, [(T1, "Available", 100.0), (T3, "Available", 150.0)])
    assert inside["rank3_used"] and inside["rank3_guard_reason"] == "within_anchor_guard"
    assert inside["market_price_usd"] == round((100 * 2 + 150 * 0.65) / 2.65, 2)
    outside = market(spark, [(T2, "Available", 100.0), (T3, "Available", 161.0)])
    assert outside["rank3_guard_triggered"] and outside["market_price_usd"] == 100.0
    below = market(spark, [(T1, "Available", 100.0), (T3, "Available", 39.0)])
    assert below["rank3_guard_reason"] == "rank3_below_anchor_guard"


def test_tier3_without_anchor(spark):
    r = market(spark, [(T3, "Available", 80.0)])
    assert (r["market_price_usd"], r["rank3_guard_reason"]) == (80.0, "no_anchor")


def test_two_first_tier_prices_weigh_as_three(spark):
    r = market(spark, [(T1, "Available", 100.0), (T1, "Available", 100.0), (T2, "Available", 50.0)])
    assert r["rank_weights"]["rank1"] == 3.0
    assert r["market_price_usd"] == round((300 + 50 * 0.7) / 3.7, 2)


def test_only_unlisted_sites(spark):
    rows = [(NONE, "Available", 90.0), (NONE, "Available", 0.0), (NONE, "Available", None)]
    r = market(spark, rows)
    assert r["market_price_usd"] is None and r["raw_median_usd"] == 90.0
    assert (r["count_items"], r["count_priced"], r["count_priced_unranked"]) == (3, 1, 1)
    h = headline_price(frame(spark, rows)).first()
    assert h["median_price_usd"] == 90.0


def test_no_prices_at_all(spark):
    h = headline_price(frame(spark, [(T1, "Sold", None)])).first()
    assert h["analysis_id"] == "a" and h["median_price_usd"] is None


def test_other_statuses_count_only_in_the_overall_median(spark):
    m = raw_medians(frame(spark, [(T1, "Unknown", 10.0), (T1, "Sold", 30.0)])).first()
    assert (m["median_price_raw_usd"], m["raw_median_sold_usd"], m["raw_median_available_usd"]) == (20.0, 30.0, None)


def test_against_plain_python_on_random_rows(spark):
    rng = random.Random(7)
    rows = [(T1, "Sold", round(rng.uniform(20, 900), 2)) for _ in range(501)] + [(T1, "Sold", 55.5)] * 40
    t = tier_prices(frame(spark, rows)).first()
    prices = [p for _, _, p in rows]
    med = statistics.median(prices)
    mean = statistics.fmean(min(max(p, med * 0.7), med * 1.2) for p in prices)
    assert t["median_usd"] == round(med, 2) and t["price_usd"] == pytest.approx(mean, abs=0.006)


def test_approx_is_close(spark):
    rows = [(T1, "Sold", 1000.0 + i * 1.37) for i in range(300)]
    exact, near = tier_prices(frame(spark, rows)).first(), tier_prices(frame(spark, rows), approx=True).first()
    assert near["median_usd"] == pytest.approx(exact["median_usd"], rel=1e-3)


def test_shuffled_input_gives_the_same(spark):
    rng = random.Random(3)
    rows = [(s, st, round(rng.uniform(20, 400), 2)) for s in (T1, T2, T3) for st in ("Sold", "Available") for _ in range(20)]
    first = sorted(map(str, market_prices(frame(spark, rows)).collect()))
    rng.shuffle(rows)
    assert sorted(map(str, market_prices(frame(spark, rows).repartition(7)).collect())) == first
