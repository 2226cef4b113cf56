"""Queries: look-ups, currency conversion and market prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.status import status_norm
from ..operators import lookups, price_states, pricing
from ..streaming.run import shared_dir
from .fixtures import fixture
from .registry import any_like, cte, mapping, query, rnd


def items(spark: SparkSession, d: str) -> DataFrame:
    """Listings with site, USD price and five-valued status."""
    base = lookups.with_site(fixture(spark, d, "listings"))
    converted = lookups.to_usd(base, fixture(spark, d, "rates"), out="price")
    return lookups.with_tier(converted).withColumn("status", status_norm("status"))


cte(
    "status_of",
    f"""SELECT DISTINCT status AS raw,
        CASE WHEN status IS NULL OR trim(status) = '' THEN NULL
             WHEN {any_like('lower(status)', fixed.STATUS_BLOCKED)} THEN 'Blocked'
             WHEN {any_like('lower(status)', fixed.STATUS_SOLD)} THEN 'Sold'
             WHEN {any_like('lower(status)', fixed.STATUS_AVAILABLE)} THEN 'Available'
             WHEN {any_like('lower(status)', fixed.STATUS_CATALOG)} THEN 'Catalog'
             WHEN lower(trim(status)) IN ('unknown', 'none', 'null', 'n/a', 'неизвестно') THEN 'Unknown'
             ELSE trim(status) END AS st FROM @listings""",
)
_CODE = "CASE l.currency_original WHEN '£' THEN 'GBP' WHEN 'jpy' THEN 'JPY' ELSE l.currency_original END"
cte(
    "items",
    f"""SELECT l.* EXCLUDE (status), s.st AS status,
        {mapping('l.domain', fixed.SITE_BY_DOMAIN, 'l.domain')} AS site,
        {mapping('l.domain', {d: fixed.TIER_BY_SITE[s] for d, s in fixed.SITE_BY_DOMAIN.items()})} AS tier,
        {_CODE} AS code,
        CASE WHEN {_CODE} = 'USD' THEN l.price_original
             WHEN r.rate > 0 THEN {rnd('l.price_original / r.rate')} END AS price
        FROM @listings l LEFT JOIN @rates r ON r.code = {_CODE}
        LEFT JOIN @status_of s ON s.raw IS NOT DISTINCT FROM l.status""",
)
cte(
    "tiers",
    f"""SELECT analysis_id, status_kind, tier, count(*) AS count, any_value(m) AS med,
        {rnd('any_value(m)')} AS median_usd, {rnd('any_value(m) * 0.7')} AS floor_usd, {rnd('any_value(m) * 1.2')} AS ceiling_usd,
        {rnd('avg(greatest(least(price, m * 1.2), m * 0.7))')} AS price_usd,
        count(*) FILTER (price < m * 0.7) AS clamped_low_count, count(*) FILTER (price > m * 1.2) AS clamped_high_count
        FROM (SELECT *, lower(status) AS status_kind,
                     median(price) OVER (PARTITION BY analysis_id, lower(status), tier) AS m
              FROM @items WHERE lower(status) IN ('sold', 'available') AND price > 0 AND tier IS NOT NULL)
        GROUP BY 1, 2, 3""",
)
cte(
    "market",
    f"""SELECT *, CASE WHEN w1 + w2 + w3 > 0 THEN {rnd('(coalesce(p1, 0) * w1 + coalesce(p2, 0) * w2 + coalesce(p3, 0) * w3) / (w1 + w2 + w3)')} END AS market_price_usd
        FROM (SELECT *, CASE WHEN n1 = 1 THEN 2.0E0 WHEN n1 = 2 THEN 3.0E0 ELSE n1 * 1.0E0 END AS w1, n2 * 0.7E0 AS w2,
              CASE WHEN used THEN n3 * 0.65E0 ELSE 0.0E0 END AS w3
        FROM (SELECT *, coalesce(reason IN ('no_anchor', 'within_anchor_guard'), FALSE) AS used
        FROM (SELECT *, CASE WHEN p3 IS NULL THEN NULL WHEN coalesce(p1, p2) IS NULL THEN 'no_anchor'
              WHEN p3 < 0.4E0 * coalesce(p1, p2) THEN 'rank3_below_anchor_guard'
              WHEN p3 > 1.6E0 * coalesce(p1, p2) THEN 'rank3_above_anchor_guard' ELSE 'within_anchor_guard' END AS reason
        FROM (SELECT analysis_id, lower(status) AS status_kind, count(*) AS count_items,
              count(*) FILTER (price > 0) AS count_priced,
              count(*) FILTER (price > 0 AND tier IS NOT NULL) AS count_priced_ranked,
              {rnd('median(price) FILTER (price > 0)')} AS raw_median_usd
              FROM @items WHERE lower(status) IN ('sold', 'available') GROUP BY 1, 2) a
        LEFT JOIN (SELECT analysis_id, status_kind,
              max(price_usd) FILTER (tier = 1) AS p1, max(price_usd) FILTER (tier = 2) AS p2, max(price_usd) FILTER (tier = 3) AS p3,
              coalesce(max(count) FILTER (tier = 1), 0) AS n1, coalesce(max(count) FILTER (tier = 2), 0) AS n2,
              coalesce(max(count) FILTER (tier = 3), 0) AS n3 FROM @tiers GROUP BY 1, 2) t USING (analysis_id, status_kind))))""",
)


@query("site_lookup", "SELECT site, (domain <> site) AS listed, count(*) AS n FROM @items GROUP BY 1, 2")
def site_lookup(spark, d):
    sited = lookups.with_site(fixture(spark, d, "listings"))
    return sited.groupBy("site", F.col("supported").alias("listed")).agg(F.count(F.lit(1)).alias("n"))


@query("tier_lookup", "SELECT domain, tier, count(*) AS n FROM @items GROUP BY 1, 2")
def tier_lookup(spark, d):
    tiered = lookups.with_tier(fixture(spark, d, "listings"))
    return tiered.groupBy("domain", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("supported_domains", "SELECT domain, count(*) AS n FROM @listings WHERE domain NOT IN ('example.com', 'shop-test.org') GROUP BY 1")
def supported_domains(spark, d):
    return lookups.filter_supported(fixture(spark, d, "listings")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("to_usd", "SELECT pos, price_original, currency_original, price AS price_usd FROM @items")
def to_usd(spark, d):
    out = lookups.to_usd(fixture(spark, d, "listings"), fixture(spark, d, "rates"))
    return out.select("pos", "price_original", "currency_original", "price_usd")


@query(
    "to_usd_asof",
    f"""SELECT event_id, price_original, currency_original,
        CASE WHEN currency_original = 'USD' THEN price_original ELSE (
            SELECT CASE WHEN r.rate > 0 THEN {rnd('p.price_original / r.rate')} END FROM @rate_history r
            WHERE r.code = p.currency_original AND r.as_of <= p.ts
              AND epoch_us(p.ts) - epoch_us(r.as_of) < 3600000000 ORDER BY r.as_of DESC LIMIT 1) END AS price_usd
        FROM @dated_prices p""",
)
def to_usd_asof(spark, d):
    out = lookups.to_usd_asof(fixture(spark, d, "dated_prices"), fixture(spark, d, "rate_history"))
    return out.select("event_id", "price_original", "currency_original", "price_usd")


@query(
    "tier_prices",
    """SELECT analysis_id, status_kind, tier, count, median_usd, floor_usd, ceiling_usd, price_usd,
        clamped_low_count, clamped_high_count FROM @tiers""",
)
def tier_prices(spark, d):
    return pricing.tier_prices(items(spark, d))


_MARKET_SQL = f"""SELECT analysis_id, status_kind, market_price_usd, raw_median_usd, count_items, count_priced, count_priced_ranked,
        count_priced - count_priced_ranked AS count_priced_unranked, used AS rank3_used,
        coalesce(reason IN ('rank3_below_anchor_guard', 'rank3_above_anchor_guard'), FALSE) AS rank3_guard_triggered,
        reason AS rank3_guard_reason, {rnd('w1', 3)} AS weight1, {rnd('w2', 3)} AS weight2, {rnd('w3', 3)} AS weight3
        FROM @market"""


@query("market_prices", _MARKET_SQL)
def market_prices(spark, d):
    out = pricing.market_prices(items(spark, d))
    return out.select(
        *[c for c in out.columns if c not in ("rank_weights", "ranks")],
        *[F.col(f"rank_weights.rank{t}").alias(f"weight{t}") for t in (1, 2, 3)],
    )


@query(
    "medians_by_day",
    "SELECT analysis_id, status_kind, raw_median_usd, count_items, count_priced, count_priced_ranked FROM @market",
)
def medians_by_day(spark, d):
    """From states of thirty days, written in two runs; sketches large enough to be exact here."""
    rows, path = items(spark, d).withColumn("day", (F.col("pos") % 30).cast("int")), shared_dir(spark)
    for half in (0, 1):
        price_states.write_states(rows.where(F.col("day") % 2 == half), path, k=8000)
    out = price_states.market_prices_of_states(spark.read.parquet(path), k=8000)
    return out.select("analysis_id", "status_kind", "raw_median_usd", "count_items", "count_priced", "count_priced_ranked")


@query(
    "raw_medians",
    f"""SELECT analysis_id, {rnd('median(price) FILTER (price > 0)')} AS median_price_raw_usd,
        {rnd("median(price) FILTER (price > 0 AND status = 'Sold')")} AS raw_median_sold_usd,
        {rnd("median(price) FILTER (price > 0 AND status = 'Available')")} AS raw_median_available_usd
        FROM @items GROUP BY 1""",
)
def raw_medians(spark, d):
    return pricing.raw_medians(items(spark, d))


@query(
    "headline_price",
    f"""SELECT i.analysis_id, coalesce(max(m.market_price_usd) FILTER (m.status_kind = 'available'),
          max(m.market_price_usd) FILTER (m.status_kind = 'sold'), any_value(i.raw)) AS median_price_usd,
        max(m.market_price_usd) FILTER (m.status_kind = 'available') AS median_price_available_usd,
        max(m.market_price_usd) FILTER (m.status_kind = 'sold') AS median_price_sold_usd,
        any_value(i.raw) AS median_price_raw_usd
        FROM (SELECT analysis_id, {rnd('median(price) FILTER (price > 0)')} AS raw FROM @items GROUP BY 1) i
        LEFT JOIN @market m USING (analysis_id) GROUP BY 1""",
)
def headline_price(spark, d):
    return pricing.headline_price(items(spark, d))
