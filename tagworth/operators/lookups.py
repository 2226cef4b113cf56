"""Look-ups of site, tier and exchange rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.money import currency_code
from ..functions.urls import domain_of, is_ebay
from ..functions.base import lookup
from ..sources.dims import domain_dim


def _session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _with_domain(df: DataFrame) -> DataFrame:
    return df if "domain" in df.columns else df.withColumn("domain", domain_of("url"))


def filter_supported(df: DataFrame) -> DataFrame:
    """Rows of supported domains (33 fixed ones, broadcast)."""
    dim = domain_dim(_session(df)).select("domain")
    return _with_domain(df).join(F.broadcast(dim), "domain", "left_semi")


def with_site(df: DataFrame) -> DataFrame:
    """Site key, the domain itself where unlisted; plus ``supported``."""
    dim = domain_dim(_session(df)).select("domain", F.col("site").alias("_site"))
    return (
        _with_domain(df)
        .drop("site")
        .join(F.broadcast(dim), "domain", "left")
        .withColumn("site", F.coalesce("_site", "domain"))
        .withColumn("supported", F.col("_site").isNotNull())
        .drop("_site")
    )


def tier_of(site: Column, domain: Column) -> Column:
    """Source tier 1..3 by eBay domain, site key, then domain; null when unlisted."""
    by_domain = {d: fixed.TIER_BY_SITE[s] for d, s in fixed.SITE_BY_DOMAIN.items()}
    return F.when((F.lower(F.trim(site)) == "ebay") | is_ebay(domain), F.lit(1)).otherwise(
        F.coalesce(lookup(F.lower(F.trim(site)), fixed.TIER_BY_SITE), lookup(domain, by_domain))
    )


def with_tier(df: DataFrame) -> DataFrame:
    """Source tier.  A 15-entry literal table needs no join at all."""
    base = _with_domain(df)
    site = F.col("site") if "site" in base.columns else F.lit(None).cast("string")
    return base.withColumn("tier", tier_of(F.coalesce(site, F.lit("")), F.col("domain")))


def _usd(amount: Column, code: Column, rate: Column) -> Column:
    """USD and unknown codes pass through; a missing or non-positive rate gives null."""
    converted = F.when(rate > 0, F.round(F.try_divide(amount, rate), 2))
    return F.when(code.isNull() | (code == "USD"), amount).otherwise(converted)


def to_usd(df: DataFrame, rates: DataFrame, amount: str = "price_original", currency: str = "currency_original", out: str = "price_usd") -> DataFrame:
    """Convert with USD-base quotes ``(code, rate)``, one per code.

    No broadcast hint: Spark broadcasts the rates when their size allows, and the join
    falls back to a shuffle with skew splitting when it does not.
    """
    quotes = rates.select(F.col("code").alias("_code"), F.col("rate").alias("_rate"))
    return (
        df.withColumn("_cur", currency_code(currency))
        .join(quotes, F.col("_cur") == F.col("_code"), "left")
        .withColumn(out, _usd(F.col(amount), F.col("_cur"), F.col("_rate")))
        .drop("_cur", "_code", "_rate")
    )


def to_usd_asof(
    df: DataFrame,
    rates: DataFrame,
    ts: str = "ts",
    ttl: int = 3600,
    amount: str = "price_original",
    currency: str = "currency_original",
    out: str = "price_usd",
) -> DataFrame:
    """Convert with the newest quote that is younger than ``ttl`` seconds at ``ts``.

    Quotes become validity intervals that do not overlap (until the next quote or until
    they expire), cut at multiples of ``ttl``.  Each row then meets at most one quote by
    an equality join on code and time slot, so a busy currency is spread over slots, also
    where a quote looks for the next one, and no row is multiplied.
    """
    span = ttl * 1_000_000
    start = F.unix_micros(F.col("as_of").cast("timestamp"))
    quotes = rates.withColumn("_from", start).withColumn("_own", F.floor(start / span))
    # a quote that ends another before it expires lies in the same slot or opens the next one
    in_slot = Window.partitionBy("code", "_own").orderBy("_from")
    openings = quotes.groupBy(F.col("code").alias("_c"), (F.col("_own") - 1).alias("_s")).agg(F.min("_from").alias("_opening"))
    followed = quotes.withColumn("_following", F.lead("_from").over(in_slot)).join(
        openings, (F.col("code") == F.col("_c")) & (F.col("_own") == F.col("_s")), "left"
    )
    intervals = (
        followed.withColumn("_to", F.least(F.col("_from") + span, F.coalesce("_following", "_opening", F.col("_from") + span)))
        .withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_from") / span), F.floor((F.col("_to") - 1) / span))))
        .select(F.col("code").alias("_code"), F.col("rate").alias("_rate"), "_from", "_to", F.col("_slot").alias("_rate_slot"))
    )
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return (
        df.withColumn("_cur", currency_code(currency))
        .withColumn("_at", at)
        .withColumn("_slot", F.floor(F.col("_at") / span))
        .join(
            intervals,
            (F.col("_cur") == F.col("_code"))
            & (F.col("_slot") == F.col("_rate_slot"))
            & (F.col("_at") >= F.col("_from"))
            & (F.col("_at") < F.col("_to")),
            "left",
        )
        .withColumn(out, _usd(F.col(amount), F.col("_cur"), F.col("_rate")))
        .drop("_cur", "_at", "_slot", "_code", "_rate", "_from", "_to", "_rate_slot")
    )
