"""Brand, domain and page-type gates with their reject reasons."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.automaton import Automaton
from ..functions.base import text
from ..functions.urls import catalog_reason, domain_of, is_product_page
from ..functions.words import brand_of, brand_token, ngrams
from .groups import staged, top_k
from .lookups import with_site

REJECT_COLUMNS = ["analysis_id", "url", "title", "site", "reason", "reason_code", "evidence"]


def exact_rank(source: str = "serp_source") -> Column:
    """0 for exact matches, 1 for all other sources."""
    return F.when(F.col(source) == "exact_matches", F.lit(0)).otherwise(F.lit(1))


def place(df: DataFrame) -> list[Column]:
    """Input order of candidate rows: section, position, url."""
    return [F.col(c) for c in ("section_rank", "pos", "url") if c in df.columns]


def exact_first(df: DataFrame) -> list[Column]:
    return [exact_rank(), *place(df)]


def infer_brand(
    cands: DataFrame, hints: DataFrame | None = None, sample: int | None = None, min_count: int = 3, min_ratio: float = 0.55
) -> DataFrame:
    """Target brand per analysis: a hint, else the vote of its candidates.

    All candidates vote; ``sample`` leaves the vote to the first ones, exact matches
    first.  Ties go to the later name.  ``hints`` has ``analysis_id`` and ``brand_hint``.
    """
    first = cands if sample is None else top_k(cands, ["analysis_id"], exact_first(cands), sample, "_rank")
    votes = first.groupBy("analysis_id", brand_of("title", "url").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    winner = votes.groupBy("analysis_id").agg(
        F.coalesce(F.sum(F.when(F.col("brand").isNotNull(), F.col("n"))), F.lit(0)).alias("known_brand_hits"),
        F.max(F.when(F.col("brand").isNotNull(), F.struct("n", "brand"))).alias("_best"),
    )
    ratio = F.col("_best.n") / F.col("known_brand_hits")
    strong = (F.col("_best.n") >= min_count) & (ratio >= min_ratio)
    out = winner.withColumn("winner_count", F.col("_best.n")).withColumn("winner_ratio", F.round(ratio, 3))
    hinted = F.lit(None).cast("string")
    if hints is not None:
        out = out.join(hints.select("analysis_id", brand_of("brand_hint").alias("_hint")), "analysis_id", "left")
        hinted = F.col("_hint")
    mode = (
        F.when(hinted.isNotNull(), F.lit("request_hint"))
        .when(F.col("_best").isNull(), F.lit("auto_no_brand_found"))
        .when(strong, F.lit("auto_inferred"))
        .otherwise(F.lit("auto_weak_signal"))
    )
    return out.select(
        "analysis_id",
        F.coalesce(hinted, F.when(strong, F.col("_best.brand"))).alias("target_brand"),
        mode.alias("mode"),
        "known_brand_hits",
        "winner_count",
        "winner_ratio",
    )


def detect_brand(df: DataFrame, column: str, aliases: DataFrame, key: list[str], most_aliases: int = 200_000) -> DataFrame:
    """Brand by a table of aliases of any size, longest alias first.

    Up to ``most_aliases`` aliases (counted) go to the tasks as one automaton, through which
    texts pass word by word in place, without a shuffle.  With more, texts are cut into
    word runs, as long as the longest alias, that meet the aliases by equality; ``key``
    then names the row key.  For the built-in aliases :func:`brand_of` needs neither.
    """
    words = F.filter(F.split(brand_token(column), " "), lambda w: w != "")
    known = aliases.select("alias", "alias_len", "brand").limit(most_aliases + 1).collect()
    if len(known) <= most_aliases:
        return df.withColumn("brand", _brand_finder(df.sparkSession, known)(words))
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    runs = F.concat(*[ngrams(F.col("_w"), n) for n in range(1, longest + 1)])
    grams = df.select(*key, words.alias("_w")).select(*key, F.explode(F.array_distinct(runs)).alias("alias"))
    found = grams.join(aliases, "alias").groupBy(*key).agg(
        F.max_by("brand", F.struct("alias_len", "alias", "brand")).alias("brand")
    )
    return df.join(found, key, "left")


def _brand_finder(spark: SparkSession, known: list):
    """A function from an array of words to the brand of the longest alias in it."""
    rows = sorted({(r["alias_len"], r["alias"], r["brand"]) for r in known if r["alias"] and r["brand"] is not None})
    sent = spark.sparkContext.broadcast((Automaton([a for _, a, _ in rows], range(len(rows))), [b for *_, b in rows]))

    @F.arrow_udf("string")
    def find(words: pa.Array) -> pa.Array:
        automaton, brands = sent.value
        sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = automaton.find(words.flatten(), sizes)
        return pa.array(brands, pa.string()).take(pa.array(np.where(rank < 0, 0, rank), mask=rank < 0)) if brands else pa.nulls(len(words), pa.string())

    return find


def brand_gate(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Keep rows unless both brands are known and differ."""
    joined = df.join(targets.select("analysis_id", "target_brand"), "analysis_id", "left")
    brand = brand_of("title", "url")
    return joined.filter(F.coalesce(brand == F.col("target_brand"), F.lit(True)))


def routed(df: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Candidates with ``reason_code`` (null when kept), first failing gate wins.

    Rows without a url are dropped.
    """
    base = df.filter(text("url") != "")
    if targets is not None:
        # one row per analysis, of known size, so that candidates are not moved to a few analyses
        base = base.join(staged(targets.select("analysis_id", "target_brand")), "analysis_id", "left")
    else:
        base = base.withColumn("target_brand", F.lit(None).cast("string"))
    sited = with_site(base.drop("domain").withColumn("domain", domain_of("url"))).withColumn("detected_brand", brand_of("title", "url"))
    code = (
        F.when(F.col("detected_brand") != F.col("target_brand"), F.lit("brand_gate_mismatch"))
        .when(~F.col("supported"), F.lit("unsupported_domain"))
        .when(~is_product_page("url"), F.lit("catalog_page"))
    )
    return sited.withColumn("reason_code", code)


def _route_reason() -> Column:
    return (
        F.when(
            F.col("reason_code") == "brand_gate_mismatch",
            F.format_string("не совпал бренд (ожидался %s, найден %s)", "target_brand", "detected_brand"),
        )
        .when(
            F.col("reason_code") == "catalog_page",
            F.concat(F.lit("каталог/категория ("), catalog_reason("url"), F.lit(")")),
        )
        .otherwise(F.concat(F.lit("неподдерживаемый домен ("), F.col("domain"), F.lit(")")))
    )


def kept_of(routed_rows: DataFrame) -> DataFrame:
    return routed_rows.filter(F.col("reason_code").isNull()).drop("reason_code", "target_brand")


def rejected_of(routed_rows: DataFrame) -> DataFrame:
    mismatch = F.col("reason_code") == "brand_gate_mismatch"
    evidence = F.when(
        mismatch,
        F.create_map(F.lit("expected_brand"), F.col("target_brand"), F.lit("detected_brand"), F.col("detected_brand")),
    )
    rows = routed_rows.filter(F.col("reason_code").isNotNull())
    return rows.withColumn("reason", _route_reason()).withColumn("evidence", evidence).select(*REJECT_COLUMNS)


def route_candidates(df: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected).  Write :func:`routed` once when both sides are needed at scale."""
    rows = routed(df, targets)
    return kept_of(rows), rejected_of(rows)


def as_rejected(df: DataFrame, code: str, reason: Column, evidence: Column | None = None) -> DataFrame:
    """Rows of any stage in the shape of the rejection log."""
    base = df if "site" in df.columns else with_site(df)
    none = F.lit(None).cast("map<string,string>")
    return (
        base.withColumn("reason_code", F.lit(code))
        .withColumn("reason", reason)
        .withColumn("evidence", none if evidence is None else evidence)
        .select(*REJECT_COLUMNS)
    )


def rejections(*parts: DataFrame) -> DataFrame:
    """Rejection log of all stages."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
