"""Visual gates over image features.

Candidates carry ``embedding``, ``colors`` and ``phash``; each analysis has one source
image, so pairing is an equality join that never multiplies rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import color_similarity, cosine01, hamming, hash_penalty, norm
from .routing import as_rejected


@dataclass(frozen=True)
class Thresholds:
    """Limits of the visual gate and their relaxation for title-selected rows."""

    floor: float = 0.3
    similarity: float = 0.85
    color: float = 0.65
    distance: int = 12
    relax_similarity: float = 0.02
    relax_color: float = 0.08
    relax_distance: int = 10


def pair_with_source(cands: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates with the features of their analysis' source image."""
    source = sources.select(
        "analysis_id",
        F.col("embedding").alias("src_embedding"),
        F.col("colors").alias("src_colors"),
        F.col("phash").alias("src_phash"),
        norm("embedding").alias("src_norm"),
    )
    return cands.join(source, "analysis_id")


def visual_metrics(pairs: DataFrame) -> DataFrame:
    """Raw similarity, colour similarity and hash distance of every pair."""
    return pairs.withColumns(
        {
            "clip_similarity": cosine01("src_embedding", "embedding", norm_a=F.col("src_norm")),
            "color_similarity": color_similarity("src_colors", "colors"),
            "phash_distance": hamming("src_phash", "phash"),
        }
    ).drop("src_embedding", "src_colors", "src_phash", "src_norm", "embedding", "colors", "phash")


def visual_gate(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Filter flag, final similarity and reason; checks run in a fixed order.

    Values of checks that were not reached are null.
    """
    sim, color, distance = F.col("clip_similarity"), F.col("color_similarity"), F.col("phash_distance")
    reason = (
        F.when(sim < t.floor, F.lit("clip_similarity_too_low"))
        .when(sim < t.similarity, F.lit(f"clip_similarity_below_threshold_{t.similarity:.2f}"))
        .when(color < t.color, F.lit(f"color_similarity_below_threshold_{t.color:.2f}_different_color"))
    )
    flagged = metrics.withColumn("filter_reason", reason).withColumn("filtered", F.col("filter_reason").isNotNull())
    final = F.when(F.col("filtered"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), hash_penalty(sim, distance, t.distance)))
    return flagged.withColumns(
        {
            "final_similarity": final,
            "color_similarity": F.when(sim >= t.similarity, color),
            "phash_distance": F.when(~F.col("filtered"), distance),
            "passed_color_check": ~F.coalesce(F.col("filter_reason").startswith("color_"), F.lit(False)),
            "passed_phash_check": F.col("filtered") | F.coalesce(distance <= t.distance, F.lit(True)),
        }
    )


def visual_rank(cands: DataFrame, sources: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Gate result of every candidate against its source image."""
    return visual_gate(visual_metrics(pair_with_source(cands, sources)), t)


def visual_reason_code(min_similarity: Column) -> Column:
    """Reason code of a row that did not pass."""
    raw = F.coalesce("filter_reason", F.lit(""))
    penalised = (
        ~F.col("filtered")
        & (F.col("clip_similarity") >= min_similarity)
        & (F.col("final_similarity") < min_similarity)
        & F.col("phash_distance").isNotNull()
    )
    return (
        F.when(raw.contains("color_similarity_below_threshold"), F.lit("color_mismatch"))
        .when(raw.contains("phash"), F.lit("phash_mismatch"))
        .when(raw.contains("clip_similarity"), F.lit("clip_below_threshold"))
        .when(penalised, F.lit("phash_penalty_final_below"))
        .otherwise(F.lit("clip_below_threshold"))
    )


def visual_accept(df: DataFrame, t: Thresholds = Thresholds(), selected: str = "title_selected") -> DataFrame:
    """``pass_mode`` (null when rejected) and ``reason_code`` (null when accepted).

    Title-selected rows pass under relaxed limits, by raw similarity, or when each
    component is close enough.
    """
    relaxed = F.col(selected)
    pick = lambda own, eased: F.when(relaxed, F.lit(eased)).otherwise(F.lit(own))
    sim = pick(t.similarity, max(0.0, min(1.0, t.similarity - t.relax_similarity)))
    color = pick(t.color, max(0.0, min(1.0, t.color - t.relax_color)))
    distance = pick(t.distance, max(0, t.distance + t.relax_distance))
    open_row = ~F.col("filtered")
    clip = F.col("clip_similarity")
    by_final = open_row & (F.col("final_similarity") >= sim)
    by_raw = open_row & relaxed & (clip >= sim)
    color_ok = F.col("color_similarity").isNull() | (F.col("color_similarity") >= color)
    hash_ok = F.col("phash_distance").isNull() | (F.col("phash_distance") <= distance)
    by_parts = relaxed & (clip >= sim) & color_ok & hash_ok
    mode = (
        F.when(by_final, F.lit("final"))
        .when(by_raw, F.lit("raw_clip_for_ai_selected"))
        .when(by_parts, F.lit("relaxed_color_phash_for_ai_selected"))
    )
    return df.withColumn("pass_mode", mode).withColumn(
        "reason_code", F.when(F.col("pass_mode").isNull(), visual_reason_code(sim))
    )


def shape_gate(df: DataFrame, threshold: float = 0.42) -> DataFrame:
    """Rows whose silhouette fits; rows without a score pass."""
    return df.filter(F.col("shape_similarity").isNull() | (F.col("shape_similarity") >= threshold))


def shape_rejected(df: DataFrame, threshold: float = 0.42) -> DataFrame:
    shape = F.round("shape_similarity", 3)
    reason = F.format_string(f"не совпал силуэт модели (shape=%.3f, порог={threshold:.2f})", F.col("shape_similarity").cast("double"))
    evidence = F.create_map(
        F.lit("shape_similarity"), shape.cast("string"), F.lit("shape_threshold"), F.lit(str(threshold))
    )
    return as_rejected(df.filter(F.col("shape_similarity") < threshold), "shape_gate_mismatch", reason, evidence)
