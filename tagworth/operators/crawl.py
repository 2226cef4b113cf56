"""Crawl health from fetch events.

Sequences per domain or proxy are cut into time slots, so that a domain with very many
events is spread over tasks; what crosses a slot border is carried explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.base import ColumnOrName, has_any, text


def error_class(c: ColumnOrName) -> Column:
    """soft_block, hard_block, network, critical_proxy, other; null without an error text."""
    low = F.lower(text(c))
    return (
        F.when(low == "", F.lit(None).cast("string"))
        .when(has_any(low, fixed.SOFT_ERROR_TOKENS), F.lit("soft_block"))
        .when(has_any(low, fixed.HARD_ERROR_TOKENS), F.lit("hard_block"))
        .when(has_any(low, fixed.NETWORK_ERROR_TOKENS), F.lit("network"))
        .when(has_any(low, fixed.CRITICAL_ERROR_TOKENS), F.lit("critical_proxy"))
        .otherwise(F.lit("other"))
    )


def is_proxy_failure(status: ColumnOrName, error: ColumnOrName, markers: Column | None = None) -> Column:
    """The fetch failed at the proxy or tunnel rather than at the site."""
    s = F.lower(F.trim(text(status)))
    blob = F.lower(text(error))
    if markers is not None:
        pairs = F.transform(F.map_entries(markers), lambda e: F.concat_ws(":", e["key"], e["value"]))
        blob = F.concat_ws(" ", blob, F.lower(F.array_join(F.coalesce(pairs, F.array().cast("array<string>")), " ")))
    return s.isin(fixed.PROXY_STATUSES) | (s.isin(fixed.TRANSPORT_STATUSES) & has_any(blob, fixed.PROXY_ERROR_TOKENS))


def is_block(c: ColumnOrName) -> Column:
    return F.coalesce(error_class(c).isin("soft_block", "hard_block"), F.lit(False))


def _in_slots(df: DataFrame, span: int) -> DataFrame:
    """Every row in its time slot and, as context, in the next one."""
    slot = F.floor(F.col("_at") / span)
    both = F.array(F.struct(slot.alias("_slot"), F.lit(True).alias("_own")), F.struct((slot + 1).alias("_slot"), F.lit(False).alias("_own")))
    return df.select("*", F.inline(both))


def soft_block_flags(
    events: DataFrame, window_sec: int = 600, threshold: int = 2, hold_sec: int = 600, keys: tuple[str, ...] = ("domain",)
) -> DataFrame:
    """Block events with their hits in the sliding window and the hold they cause.

    ``hits`` counts the domain's block events of the last ``window_sec`` seconds;
    ``hold_until`` is the end of the hold in force right after the event, if any.
    """
    span, hold = window_sec * 1_000_000, hold_sec * 1_000_000
    blocks = events.filter(is_block("error")).withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    recent = lambda n: Window.partitionBy(*keys, "_slot").orderBy("_at").rangeBetween(-n, 0)
    hits = (
        _in_slots(blocks, span).withColumn("hits", F.count(F.lit(1)).over(recent(span))).filter("_own").drop("_slot", "_own")
    )
    trigger = F.when(F.col("hits") >= threshold, F.col("_at"))
    held = (
        _in_slots(hits, hold)
        .withColumn("_last", F.max(trigger).over(recent(hold - 1)))
        .filter("_own")
        .drop("_slot", "_own")
    )
    return held.withColumn("hold_until", F.timestamp_micros(F.col("_last") + hold)).drop("_at", "_last")


def failure_streaks(
    events: DataFrame,
    keys: tuple[str, ...] = ("proxy",),
    rotating_limit: int = 3,
    static_limit: int = 2,
    slot_sec: int = 3600,
) -> DataFrame:
    """Consecutive failures since the last success, and whether the proxy counts as bad.

    Soft blocks do not count as failures, and open fetches (``ok`` null) change nothing.  A
    rotating proxy is bad at once after a critical proxy error, until a success.  Slots
    are summarised first (failures and critical errors after the last success), the
    summaries are chained, and each slot starts from its carry.
    """
    k = list(keys)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    failed = ~F.col("ok")
    kind = F.coalesce(error_class("error"), F.lit(""))
    counts = {"_f": (failed & (kind != "soft_block")).cast("int"), "_k": (failed & (kind == "critical_proxy")).cast("int")}
    rows = events.withColumns({"_slot": F.floor(at / (slot_sec * 1_000_000)), "_s": F.coalesce(F.col("ok").cast("int"), F.lit(0))})
    rows = rows.withColumns({c: F.coalesce(v, F.lit(0)) for c, v in counts.items()})
    order = Window.partitionBy(*k, "_slot").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_g", F.sum("_s").over(order))
    inside = Window.partitionBy(*k, "_slot", "_g").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumns({f"_local{c}": F.sum(c).over(inside) for c in counts})
    # counts after the last success of a slot: partial sums per success group, newest group wins
    summary = (
        marked.groupBy(*k, "_slot", "_g")
        .agg(*[F.sum(c).alias(c) for c in counts])
        .groupBy(*k, "_slot")
        .agg(*[F.max_by(c, "_g").alias(f"_tail{c}") for c in counts], (F.max("_g") > 0).cast("int").alias("_reset"))
    )
    slots = Window.partitionBy(*k).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    chained = summary.withColumn("_island", F.sum("_reset").over(slots))
    island = Window.partitionBy(*k, "_island").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    after = chained.withColumns({f"_after{c}": F.sum(f"_tail{c}").over(island) for c in counts})
    last = Window.partitionBy(*k).orderBy("_slot")
    carry = after.select(*k, "_slot", *[F.lag(f"_after{c}", 1, 0).over(last).alias(f"_carry{c}") for c in counts])
    limit = F.when(F.col("proxy_type") == "rotating", F.lit(rotating_limit)).otherwise(F.lit(static_limit))
    since = {c: F.col(f"_local{c}") + F.when(F.col("_g") == 0, F.col(f"_carry{c}")).otherwise(0) for c in counts}
    return (
        local.join(carry, [*k, "_slot"])
        .withColumns({"streak": since["_f"].cast("long"), "_critical": since["_k"]})
        .withColumn("is_bad", (F.col("streak") >= limit) | ((F.col("proxy_type") == "rotating") & (F.col("_critical") > 0)))
        .drop("_slot", "_s", "_g", "_critical", *[p + c for c in counts for p in ("", "_local", "_carry")])
    )


def crawl_health(events: DataFrame, keys: tuple[str, ...] = ("proxy", "domain")) -> DataFrame:
    """Totals, failures by class, open fetches and last state per proxy and domain."""
    kind = error_class("error")
    counts = [F.count_if(F.coalesce(kind == c, F.lit(False))).alias(c) for c in ("soft_block", "hard_block", "network", "critical_proxy")]
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(~F.col("ok"), F.lit(False))).alias("failed"),
        F.count_if(F.col("ok").isNull()).alias("in_flight"),
        *counts,
        F.max("ts").alias("last_ts"),
        F.max_by("ok", F.struct("ts", "event_id")).alias("last_ok"),
    )
