"""Queries: visual similarity and gates over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, similarity as sim
from ..operators import visual as v
from .fixtures import load
from .registry import cte, query, rnd

# looser than the defaults, so that every branch occurs on these vectors
LIMITS = v.Thresholds(floor=0.45, similarity=0.5, color=0.80, distance=120, relax_similarity=0.02, relax_color=0.04, relax_distance=4)


def features(spark, d):
    """Embedding, three colours and a hash per vector; analysis = label."""
    e = load(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    channel = lambda i: (F.floor(F.abs(F.col("e")[i]) * 1000) % 256).cast("int")
    bits = lambda i: F.floor(F.col("e")[i] * 1e15).cast("long")
    return e.select(
        "vec_id",
        F.col("label").cast("string").alias("analysis_id"),
        F.col("vec_id").alias("pos"),
        F.col("e").alias("embedding"),
        F.array(*[F.array(*[channel(3 * c + k) for k in range(3)]) for c in range(3)]).alias("colors"),
        F.array(*[bits(10 + k) for k in range(4)]).alias("phash"),
    )


def sources(feats):
    """The lowest vector id of each label plays the source image."""
    return feats.groupBy("analysis_id").agg(
        F.min_by(F.struct("vec_id", "embedding", "colors", "phash"), "vec_id").alias("s")
    ).select("analysis_id", "s.*")


def candidates(feats):
    first = feats.groupBy("analysis_id").agg(F.min("vec_id").alias("_m"))
    return feats.join(first, "analysis_id").filter(F.col("vec_id") > F.col("_m")).drop("_m")


_RGB = ", ".join("[" + ", ".join(f"CAST(floor(abs(e[{3 * c + k + 1}]) * 1000) AS INT) % 256" for k in range(3)) + "]" for c in range(3))
_BITS = ", ".join(f"CAST(floor(e[{k + 11}] * 1e15) AS BIGINT)" for k in range(4))
cte("feats", f"SELECT *, [{_RGB}] AS colors, [{_BITS}] AS phash FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM {{embeddings}})")
cte(
    "pairs",
    """SELECT c.vec_id, c.label, c.e, c.colors, c.phash, s.e AS se, s.colors AS scolors, s.phash AS shash FROM @feats c
       JOIN (SELECT * FROM @feats WHERE vec_id IN (SELECT min(vec_id) FROM @feats GROUP BY label)) s ON c.label = s.label AND c.vec_id > s.vec_id""",
)
_DIST = "sqrt((a[1]-b[1])*(a[1]-b[1]) + (a[2]-b[2])*(a[2]-b[2]) + (a[3]-b[3])*(a[3]-b[3]))"
cte(
    "metrics",
    f"""SELECT vec_id, label, (list_cosine_similarity(se, e) + 1) / 2 AS sim,
        greatest(0, least(1, 1 - list_sum(list_transform(scolors, lambda a: list_min(list_transform(colors, lambda b: {_DIST})))) / 3 / 441.0)) AS col,
        list_sum(list_transform(range(1, 5), lambda i: bit_count(xor(shash[i], phash[i])))) AS dist FROM @pairs""",
)
cte(
    "gated",
    """SELECT *, CASE WHEN reason IS NOT NULL THEN 0 WHEN dist > 240 THEN sim * 0.3 WHEN dist > 120 THEN sim * (1 - 0.4 * least(1, dist / 240.0)) ELSE sim END AS final
       FROM (SELECT *, CASE WHEN sim < 0.45 THEN 'clip_similarity_too_low' WHEN sim < 0.5 THEN 'clip_similarity_below_threshold_0.50'
         WHEN col < 0.80 THEN 'color_similarity_below_threshold_0.80_different_color' END AS reason FROM @metrics)""",
)


def _metrics(spark, d):
    feats = features(spark, d)
    return v.visual_metrics(v.pair_with_source(candidates(feats), sources(feats)))


@query("pair_with_source", "SELECT vec_id, CAST(label AS VARCHAR) AS analysis_id, shash[1] AS first_hash FROM @pairs")
def pair_with_source(spark, d):
    feats = features(spark, d)
    out = v.pair_with_source(candidates(feats), sources(feats))
    return out.select("vec_id", "analysis_id", F.col("src_phash")[0].alias("first_hash"))


@query("cosine01", f"SELECT vec_id, {rnd('sim', 6)} AS similarity FROM @metrics")
def cosine01(spark, d):
    return _metrics(spark, d).select("vec_id", F.round("clip_similarity", 6).alias("similarity"))


@query("color_similarity", f"SELECT vec_id, {rnd('col', 6)} AS color FROM @metrics")
def color_similarity(spark, d):
    return _metrics(spark, d).select("vec_id", F.round("color_similarity", 6).alias("color"))


@query("hamming", "SELECT vec_id, CAST(dist AS BIGINT) AS distance FROM @metrics")
def hamming(spark, d):
    return _metrics(spark, d).select("vec_id", F.col("phash_distance").cast("long").alias("distance"))


@query(
    "hash_penalty",
    f"SELECT vec_id, {rnd('CASE WHEN dist > 240 THEN sim * 0.3 WHEN dist > 120 THEN sim * (1 - 0.4 * least(1, dist / 240.0)) ELSE sim END', 6)} AS similarity FROM @metrics",
)
def hash_penalty(spark, d):
    return _metrics(spark, d).select("vec_id", F.round(sim.hash_penalty("clip_similarity", "phash_distance", 120), 6).alias("similarity"))


@query(
    "visual_rank",
    f"""SELECT vec_id, reason AS filter_reason, reason IS NOT NULL AS filtered, {rnd('final', 6)} AS final_similarity,
        CASE WHEN reason IS NULL THEN CAST(dist AS BIGINT) END AS phash_distance, {rnd('CASE WHEN sim >= 0.5 THEN col END', 6)} AS color_similarity FROM @gated""",
)
def visual_rank(spark, d):
    feats = features(spark, d)
    out = v.visual_rank(candidates(feats), sources(feats), LIMITS)
    return out.select(
        "vec_id", "filter_reason", "filtered", F.round("final_similarity", 6).alias("final_similarity"),
        F.col("phash_distance").cast("long").alias("phash_distance"), F.round("color_similarity", 6).alias("color_similarity"),
    )


cte(
    "accepted",
    """SELECT *, CASE WHEN reason IS NULL AND final >= ms THEN 'final' WHEN reason IS NULL AND sel AND sim >= ms THEN 'raw_clip_for_ai_selected'
        WHEN sel AND sim >= ms AND (sim < 0.5 OR col >= 0.76) AND (reason IS NOT NULL OR dist <= 124) THEN 'relaxed_color_phash_for_ai_selected' END AS pass_mode
        FROM (SELECT *, vec_id % 2 = 0 AS sel, CASE WHEN vec_id % 2 = 0 THEN 0.48 ELSE 0.5 END AS ms FROM @gated)""",
)
_CODE = """CASE WHEN pass_mode IS NOT NULL THEN NULL WHEN contains(coalesce(reason, ''), 'color_') THEN 'color_mismatch'
    WHEN reason IS NULL AND sim >= ms AND final < ms THEN 'phash_penalty_final_below' ELSE 'clip_below_threshold' END"""


def _accepted(spark, d):
    feats = features(spark, d)
    gated = v.visual_rank(candidates(feats), sources(feats), LIMITS).withColumn("title_selected", F.col("vec_id") % 2 == 0)
    return v.visual_accept(gated, LIMITS)


@query("visual_accept", f"SELECT vec_id, pass_mode, {_CODE} AS reason_code FROM @accepted")
def visual_accept(spark, d):
    return _accepted(spark, d).select("vec_id", "pass_mode", "reason_code")


@query(
    "reason_text",
    f"""SELECT vec_id, CASE code WHEN 'color_mismatch' THEN 'не совпал цвет (' || printf('%.1f%%', col * 100) || ', порог 65%)'
        WHEN 'clip_below_threshold' THEN printf('итоговая схожесть ниже порога (итоговая %.1f%%, CLIP %.1f%%, порог 85%%)', final * 100, sim * 100)
        ELSE printf('схожесть после штрафа pHash ниже порога (итоговая %.1f%%, CLIP %.1f%%, pHash %s, порог 85%%)', final * 100, sim * 100, CAST(dist AS VARCHAR)) END AS reason
        FROM (SELECT *, {_CODE} AS code FROM @accepted) WHERE code IS NOT NULL""",
)
def reason_text(spark, d):
    rejected = _accepted(spark, d).filter(F.col("reason_code").isNotNull())
    shown = display.reason_text("reason_code", "clip_similarity", "color_similarity", "phash_distance", "final_similarity")
    return rejected.select("vec_id", shown.alias("reason"))


@query(
    "shape_gate",
    "SELECT vec_id FROM {embeddings} WHERE vec_id % 5 = 0 OR abs(CAST(embedding[1] AS DOUBLE)) * 5 >= 0.42",
)
def shape_gate(spark, d):
    shape = F.when(F.col("vec_id") % 5 != 0, F.abs(F.col("embedding")[0].cast("double")) * 5)
    return v.shape_gate(load(spark, d, "embeddings").withColumn("shape_similarity", shape)).select("vec_id")


@query(
    "shape_score",
    f"""SELECT vec_id, {rnd("greatest(0, least(1, 0.55 * exp(-0.35 * g) + 0.30 * abs(e[8]) + 0.15 * least(abs(e[9]), abs(e[10])) / greatest(abs(e[9]), abs(e[10]))))", 6)} AS score
        FROM (SELECT vec_id, e, list_sum(list_transform(range(1, 8), lambda i: abs(-sign(e[i]) * log10(abs(e[i])) + sign(e[i + 20]) * log10(abs(e[i + 20]))))) / 7 AS g FROM @feats)""",
)
def shape_score(spark, d):
    e = features(spark, d)
    hu = lambda start: sim.hu_log(F.slice("embedding", start, 7))
    part = lambda i: F.abs(F.col("embedding")[i])
    return e.select("vec_id", F.round(sim.shape_score(hu(1), hu(21), part(7), part(8), part(9)), 6).alias("score"))
