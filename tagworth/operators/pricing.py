"""Robust market prices.

The listings are read once.  They shrink to counts per analysis, status, tier and cent
amount before the first shuffle; everything later works on these counts.  A busy analysis
therefore costs as many rows as it has different prices, not as many as it has listings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.status import status_norm
from .groups import value_counts
from .lookups import with_tier

_GROUP = ["analysis_id", "status_kind"]
_LEVEL = ["analysis_id", "_code"]


def price_code(status: Column, tier: Column) -> Column:
    """Status kind and tier of a row as one small number: kind * 10 + tier, 0 for neither.

    The price windows sort by it; one number is far cheaper there than three columns.
    """
    kind = F.when(status == "Sold", 1).when(status == "Available", 2).otherwise(0)
    return F.when(kind > 0, kind * 10 + F.coalesce(tier, F.lit(0))).otherwise(0)


def levels_of(code: Column) -> Column:
    """Codes of the levels a row counts for: 0 for all, 100 + kind, and its own with a tier."""
    return F.array_compact(
        F.array(F.lit(0), F.when(code > 0, 100 + F.floor(code / 10).cast("int")), F.when(code % 10 > 0, code))
    )


def named_levels(stats: DataFrame) -> DataFrame:
    """Level, status kind and tier in place of the level code."""
    code = F.col("_code")
    kind = F.when(code >= 100, code - 100).when(code > 0, F.floor(code / 10))
    return stats.withColumns(
        {
            "level": F.when(code == 0, F.lit("all")).when(code >= 100, F.lit("status")).otherwise(F.lit("tier")),
            "status_kind": F.when(kind == 1, F.lit("sold")).when(kind == 2, F.lit("available")),
            "tier": F.when((code > 0) & (code < 100), code % 10),
        }
    ).drop("_code")


def _counts(items: DataFrame, approx: bool) -> DataFrame:
    """Rows per (analysis, kind and tier, price); no positive price counts as null.

    ``approx`` keeps four significant digits, which bounds the different prices of any
    group at some ten thousand per power of ten.
    """
    base = items if "tier" in items.columns else with_tier(items)
    price = F.round(F.col("price").cast("double"), 2)
    if approx:
        scale = F.pow(F.lit(10.0), 3 - F.floor(F.log10(price)))
        price = F.when(price > 0, F.round(price * scale) / scale)
    keyed = base.select(
        "analysis_id",
        price_code(status_norm("status"), F.col("tier")).alias("_code"),
        F.when(price > 0, price).alias("price"),
    )
    return value_counts(keyed, _LEVEL, "price")


def price_levels(items: DataFrame, approx: bool = False) -> DataFrame:
    """Statistics at three levels: per tier, per status kind ("status") and over all ("all").

    ``count_items`` counts every row, ``count`` the priced ones.  A group is as large as
    its number of different cent amounts.
    """
    spread = _counts(items, approx).select("analysis_id", F.explode(levels_of(F.col("_code"))).alias("_code"), "price", "n")
    price, priced = F.col("price"), F.when(F.col("price").isNotNull(), F.col("n")).otherwise(0)
    # one sort serves both frames
    ordered = Window.partitionBy(*_LEVEL).orderBy("price")
    group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread.withColumn("_n", priced).withColumns(
        {"_total": F.sum("_n").over(group), "_upto": F.sum("_n").over(running)}
    )
    reached = lambda rank: F.min(F.when(F.col("_upto") >= rank, price)).over(group)
    middle = ranked.withColumn(
        "_median", (reached(F.floor((F.col("_total") + 1) / 2)) + reached(F.floor(F.col("_total") / 2) + 1)) / 2
    )
    low, high = F.col("_median") * 0.7, F.col("_median") * 1.2
    clamped = F.greatest(F.least(price, high), low)
    stats = middle.groupBy(*_LEVEL).agg(
        F.sum("n").alias("count_items"),
        F.sum("_n").alias("count"),
        F.round(F.max("_median"), 2).alias("median_usd"),
        F.round(F.max(low), 2).alias("floor_usd"),
        F.round(F.max(high), 2).alias("ceiling_usd"),
        F.round(F.try_divide(F.sum(clamped * F.col("_n")), F.sum("_n")), 2).alias("price_usd"),
        F.sum(F.when(price < low, F.col("n")).otherwise(0)).alias("clamped_low_count"),
        F.sum(F.when(price > high, F.col("n")).otherwise(0)).alias("clamped_high_count"),
    )
    return named_levels(stats)


_DETAIL = (
    "count", "median_usd", "floor_usd", "ceiling_usd", "price_usd", "clamped_low_count", "clamped_high_count",
)


def tier_prices(items: DataFrame, approx: bool = False) -> DataFrame:
    """Median, clamp corridor and clamped mean per analysis, status and tier."""
    tiers = price_levels(items, approx).filter((F.col("level") == "tier") & (F.col("count") > 0))
    return tiers.select(*_GROUP, "tier", *_DETAIL)


def _weighed(levels: DataFrame) -> DataFrame:
    """One row per analysis and status kind (null for all statuses) with its market price."""
    has_level = lambda name: F.col("level") == name
    own = lambda c: F.max(F.when(~has_level("tier"), F.col(c)))
    table = levels.groupBy(*_GROUP).agg(
        own("count_items").alias("count_items"),
        own("count").alias("count_priced"),
        F.coalesce(F.sum(F.when(has_level("tier"), F.col("count"))), F.lit(0)).alias("count_priced_ranked"),
        own("median_usd").alias("raw_median_usd"),
        *[
            F.max(F.when(has_level("tier") & (F.col("tier") == t) & (F.col("count") > 0), F.struct(*_DETAIL))).alias(f"rank{t}")
            for t in (1, 2, 3)
        ],
    )
    p1, p2, p3 = (F.col(f"rank{t}.price_usd") for t in (1, 2, 3))
    n1, n2, n3 = (F.coalesce(F.col(f"rank{t}.count"), F.lit(0)) for t in (1, 2, 3))
    anchor = F.coalesce(p1, p2)
    reason = (
        F.when(p3.isNull(), F.lit(None).cast("string"))
        .when(anchor.isNull(), F.lit("no_anchor"))
        .when(p3 < 0.4 * anchor, F.lit("rank3_below_anchor_guard"))
        .when(p3 > 1.6 * anchor, F.lit("rank3_above_anchor_guard"))
        .otherwise(F.lit("within_anchor_guard"))
    )
    used = F.coalesce(F.col("rank3_guard_reason").isin("no_anchor", "within_anchor_guard"), F.lit(False))
    lifted = F.when(n1 == 1, F.lit(2)).when(n1 == 2, F.lit(3)).otherwise(n1)
    weights = fixed.TIER_WEIGHTS
    total = F.col("w1") + F.col("w2") + F.col("w3")
    weighted = (
        F.coalesce(p1, F.lit(0.0)) * F.col("w1")
        + F.coalesce(p2, F.lit(0.0)) * F.col("w2")
        + F.coalesce(p3, F.lit(0.0)) * F.col("w3")
    )
    return (
        table.withColumn("rank3_guard_reason", reason)
        .withColumn("rank3_used", used)
        .withColumns(
            {
                "w1": lifted * weights[1],
                "w2": n2 * weights[2],
                "w3": F.when(F.col("rank3_used"), n3 * weights[3]).otherwise(F.lit(0.0)),
            }
        )
        .withColumn("market_price_usd", F.when(total > 0, F.round(weighted / total, 2)))
    )


def market_prices(items: DataFrame, approx: bool = False) -> DataFrame:
    """Market price per analysis and status kind.

    Tiers weigh 1.00, 0.70 and 0.65 by their counts, small first tiers a little more;
    the third tier counts only near the better tiers' price or without them.
    """
    return market_of(price_levels(items, approx))


def market_of(levels: DataFrame) -> DataFrame:
    """Market prices from the statistics of all levels."""
    out = _weighed(levels).filter(F.col("status_kind").isNotNull())
    return out.select(
        *_GROUP,
        "market_price_usd",
        "raw_median_usd",
        "count_items",
        "count_priced",
        "count_priced_ranked",
        (F.col("count_priced") - F.col("count_priced_ranked")).alias("count_priced_unranked"),
        "rank3_used",
        (F.col("rank3_guard_reason").isNotNull() & ~F.col("rank3_used")).alias("rank3_guard_triggered"),
        "rank3_guard_reason",
        F.struct(*[F.round(f"w{t}", 3).alias(f"rank{t}") for t in (1, 2, 3)]).alias("rank_weights"),
        F.struct("rank1", "rank2", "rank3").alias("ranks"),
    )


def _of_kind(kind: str, value: str) -> Column:
    return F.max(F.when(F.col("status_kind") == kind, F.col(value)))


def _of_all(value: str) -> Column:
    return F.max(F.when(F.col("status_kind").isNull(), F.col(value)))


def raw_medians(items: DataFrame, approx: bool = False) -> DataFrame:
    """Median of all positive prices per analysis, over all and per status kind."""
    levels = price_levels(items, approx).filter(F.col("level") != "tier")
    return levels.groupBy("analysis_id").agg(
        _of_all("median_usd").alias("median_price_raw_usd"),
        _of_kind("sold", "median_usd").alias("raw_median_sold_usd"),
        _of_kind("available", "median_usd").alias("raw_median_available_usd"),
    )


def headline_price(items: DataFrame, approx: bool = False) -> DataFrame:
    """The four headline numbers of an analysis: available, else sold, else raw median."""
    table = _weighed(price_levels(items, approx)).groupBy("analysis_id").agg(
        _of_kind("available", "market_price_usd").alias("median_price_available_usd"),
        _of_kind("sold", "market_price_usd").alias("median_price_sold_usd"),
        _of_all("raw_median_usd").alias("median_price_raw_usd"),
    )
    return table.select(
        "analysis_id",
        F.coalesce("median_price_available_usd", "median_price_sold_usd", "median_price_raw_usd").alias("median_price_usd"),
        "median_price_available_usd",
        "median_price_sold_usd",
        "median_price_raw_usd",
    )
