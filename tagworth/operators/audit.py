"""Counts and states for audits of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.base import lookup, text
from ..functions.status import is_status


def count_by(df: DataFrame, key: str, keys: tuple[str, ...] = ("analysis_id",)) -> DataFrame:
    return df.groupBy(*keys, key).agg(F.count(F.lit(1)).alias("n"))


def reject_counts(rejected: DataFrame) -> DataFrame:
    """Rejections per analysis as a map from reason code to count."""
    counts = rejected.groupBy("analysis_id", F.coalesce("reason_code", F.lit("unknown")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("analysis_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("reject_reason_counts")
    )


def pipeline_stats(kept: DataFrame, items: DataFrame, rejected: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Counters of one run per analysis; missing parts count as zero."""
    one = F.count(F.lit(1))
    parts = [
        kept.groupBy("analysis_id").agg(one.alias("kept_total")),
        items.groupBy("analysis_id").agg(
            one.alias("final_items"),
            F.count_if(F.coalesce(F.col("price") > 0, F.lit(False))).alias("prices_found"),
            F.count_if(is_status("status", "Blocked")).alias("blocked_items"),
        ),
        rejected.groupBy("analysis_id").agg(one.alias("rejected_total")),
    ]
    if market is not None:
        clamped = reduce(
            lambda a, b: a + b,
            [F.coalesce(F.col(f"ranks.rank{t}.clamped_{s}_count"), F.lit(0)) for t in (1, 2, 3) for s in ("low", "high")],
        )
        parts.append(market.groupBy("analysis_id").agg(F.sum(clamped).alias("clamped_prices")))
    return reduce(lambda a, b: a.join(b, "analysis_id", "full"), parts).fillna(0)


def parse_coverage(parsed: DataFrame) -> DataFrame:
    """Share of listings per site with title, price, status and condition."""
    has = lambda c: (F.trim(text(c)) != "").cast("int")
    share = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return parsed.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        share(has("title"), "with_title"),
        share(F.col("price").isNotNull().cast("int"), "with_price"),
        share(has("status"), "with_status"),
        share(has("condition"), "with_condition"),
    )


def stage_breakdown(log: DataFrame, key: str = "trace") -> DataFrame:
    """Seconds per stage and their share of the run."""
    per_stage = log.groupBy(key, "stage").agg(F.sum("seconds").alias("seconds"))
    total = F.sum("seconds").over(Window.partitionBy(key))
    return per_stage.withColumn("percent", F.when(total > 0, F.col("seconds") / total * 100).otherwise(F.lit(0.0)))


def task_status_of(raw: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(text(raw))), fixed.TASK_STATUS), F.lit("unknown"))


def task_status(events: DataFrame, tie: str = "seq") -> DataFrame:
    """Last state of every report task."""
    last = F.max_by("raw_status", F.struct("ts", tie) if tie in events.columns else F.col("ts"))
    states = events.groupBy("task_id").agg(last.alias("raw_status"), F.max("ts").alias("ts"))
    status = task_status_of(F.col("raw_status"))
    return states.withColumn("status", status).withColumn("report_ready", F.col("status") == "ready")


def task_states_for(ids: DataFrame, events: DataFrame) -> DataFrame:
    """States of the asked tasks; unknown ids are ``not_found``."""
    states = task_status(events).drop("ts")
    out = ids.select("task_id").join(states, "task_id", "left")
    return out.withColumns(
        {"status": F.coalesce("status", F.lit("not_found")), "report_ready": F.coalesce("report_ready", F.lit(False))}
    )
