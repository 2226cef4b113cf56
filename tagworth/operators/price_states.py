"""Market prices from daily states: a new day reads that day only.

A state holds the priced listings of an analysis, status and tier on one day as a quantile
sketch with its exact counts.  States of any days merge into the same table that
:func:`.pricing.price_levels` gives, up to the rank error of the sketch; groups of up to
``k`` priced rows are kept whole, so their medians are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import status_norm
from .lookups import with_tier
from .pricing import levels_of, market_of, named_levels, price_code

K = 400
GRID = 1000


def rank_error(k: int = K) -> float:
    """Rank error of a merged sketch at 99 % confidence, as a share of the rows."""
    return 2.296 / k**0.9723


def price_states(items: DataFrame, day: str = "day", k: int = K) -> DataFrame:
    """``day, analysis_id, code, count_items, count, sketch`` of listings with a ``day``.

    Rows shrink to sketches within each task, so a busy analysis is no hot spot.
    """
    base = items if "tier" in items.columns else with_tier(items)
    price = F.round(F.col("price").cast("double"), 2)
    rows = base.select(F.col(day).alias("day"), "analysis_id", price_code(status_norm("status"), F.col("tier")).alias("code"), F.when(price > 0, price).alias("price"))
    return rows.groupBy("day", "analysis_id", "code").agg(
        F.count("*").alias("count_items"), F.count("price").alias("count"), F.kll_sketch_agg_double("price", F.lit(k)).alias("sketch")
    )


def write_states(items: DataFrame, path: str, day: str = "day", k: int = K) -> None:
    """Write the states of the days in ``items``; a day that is written again is replaced."""
    states = price_states(items, day, k)
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged_states(states: DataFrame, k: int = K) -> DataFrame:
    """States of all days as one per analysis and level code."""
    spread = states.withColumn("_code", F.explode(levels_of(F.col("code"))))
    # a day without priced rows has no sketch
    return spread.groupBy("analysis_id", "_code").agg(
        F.sum("count_items").alias("count_items"), F.sum("count").alias("count"), F.kll_merge_agg_double(F.when(F.col("count") > 0, F.col("sketch")), F.lit(k)).alias("sketch")
    )


def state_levels(states: DataFrame, k: int = K, grid: int = GRID) -> DataFrame:
    """The columns of :func:`.pricing.price_levels` from merged states.

    Counts are exact and medians exact or within the rank error.  Clamped means and counts are
    taken over ``grid`` even ranks, which adds an error of half a step in rank.
    """
    n = F.col("count")
    # the smallest values with at least half, and with more than half, of the rows up to them
    ranks = [0.5, 0.5 + 1e-5, *[(i + 0.5) / grid for i in range(grid)]]
    asked = F.kll_sketch_get_quantile_double("sketch", F.lit(ranks).cast("array<double>"))
    found = merged_states(states, k).withColumn("_at", F.when(n > 0, asked))
    found = found.withColumns({"_median": (F.get("_at", F.lit(0)) + F.get("_at", F.lit(1))) / 2, "_values": F.slice("_at", 3, grid)})
    low, high = F.col("_median") * 0.7, F.col("_median") * 1.2
    total = F.aggregate("_values", F.lit(0.0), lambda s, v: s + F.greatest(F.least(v, high), low))
    share = lambda test: F.coalesce(F.round(F.size(F.filter("_values", test)) * n / grid), F.lit(0)).cast("long")
    return named_levels(
        found.select(
            "analysis_id", "_code", "count_items", "count", F.round("_median", 2).alias("median_usd"), F.round(low, 2).alias("floor_usd"), F.round(high, 2).alias("ceiling_usd"),
            F.round((total / grid), 2).alias("price_usd"),
            F.when(n > 0, share(lambda v: v < low)).otherwise(0).alias("clamped_low_count"), F.when(n > 0, share(lambda v: v > high)).otherwise(0).alias("clamped_high_count"),
        )
    )


def market_prices_of_states(states: DataFrame, k: int = K) -> DataFrame:
    """:func:`.pricing.market_prices` from states of any days."""
    return market_of(state_levels(states, k))
