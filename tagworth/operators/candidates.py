"""Merging, de-duplication, caps, ranking and crawl batches of candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.base import text
from ..functions.urls import canonical_key, domain_of, is_ebay
from .groups import beyond_top, first_rows, rank_in_group, top_k
from .membership import BITS, not_in_set
from .routing import as_rejected, exact_rank, place

A = ["analysis_id"]


def _with_domain(df: DataFrame) -> DataFrame:
    return df if "domain" in df.columns else df.withColumn("domain", domain_of("url"))


def merge_by_link(rows: DataFrame) -> DataFrame:
    """One row per link.  The first row wins; later rows fill a missing price (with its
    currency), title or image; all sources are listed in order.

    Two combining aggregates: a link that occurs very often shrinks to one row per
    source before it is brought together.
    """
    at = F.struct("section_rank", "pos")
    link = [*A, "url"]
    pick = lambda c: F.struct(at.alias("at"), F.col(c).alias("v"))
    price = F.struct("serp_price", "serp_currency")
    per_source = (
        rows.filter(text("url") != "")
        .groupBy(*link, "serp_source")
        .agg(
            F.min(at).alias("at"),
            F.min(F.when(F.col("serp_price").isNotNull(), F.struct(at.alias("at"), price.alias("v")))).alias("price"),
            F.min(F.when(text("title") != "", pick("title"))).alias("title"),
            F.min(F.when(text("image") != "", pick("image"))).alias("image"),
        )
    )
    merged = per_source.groupBy(*link).agg(
        F.min(F.struct("at", "serp_source")).alias("first"),
        F.min("price").alias("price"),
        F.min("title").alias("title"),
        F.min("image").alias("image"),
        F.array_sort(F.collect_list(F.struct("at", "serp_source"))).alias("sources"),
    )
    return merged.select(
        "analysis_id",
        "url",
        F.coalesce("image.v", F.lit("")).alias("image"),
        F.coalesce("title.v", F.lit("")).alias("title"),
        F.col("price.v.serp_price").alias("serp_price"),
        F.col("price.v.serp_currency").alias("serp_currency"),
        F.col("first.serp_source").alias("serp_source"),
        F.col("sources.serp_source").alias("serp_sources"),
        F.col("first.at.section_rank").alias("section_rank"),
        F.col("first.at.pos").alias("pos"),
    )


def distinct_links(df: DataFrame) -> DataFrame:
    """First row per url; rows without a url are dropped."""
    return first_rows(df.filter(text("url") != ""), [*A, "url"], place(df))


def cap_per_domain(df: DataFrame, cap: int, limit: int | None = None) -> DataFrame:
    """At most ``cap`` rows per domain, then at most ``limit`` per analysis, in order."""
    links = _with_domain(distinct_links(df))
    capped = top_k(links, [*A, "domain"], place(df), cap, "domain_rank")
    return capped if limit is None else top_k(capped, A, place(df), limit, "rank")


def domain_cap_rejected(df: DataFrame, cap: int, bucket: str) -> DataFrame:
    """Rows beyond the domain cap, as rejection log."""
    links = _with_domain(distinct_links(df))
    keys = [*A, "domain"]
    over = beyond_top(links, top_k(links, keys, place(df), cap), keys, place(df), cap)
    return as_rejected(
        over,
        "domain_cap",
        F.format_string(f"превышен лимит домена (%s, cap={cap}, bucket={bucket})", F.col("domain")),
    )


def two_buckets(df: DataFrame, first_cap: int = 3, first_limit: int = 20, second_cap: int = 6) -> DataFrame:
    """A capped and limited first bucket, then a second one from the remainder.

    Everything either bucket can take is among the first ``first_cap + second_cap`` rows
    of each domain, so both are cut from that small set in one pass.
    """
    near = cap_per_domain(df, first_cap + second_cap)
    order = place(df)
    eligible = F.col("domain_rank") <= first_cap
    ranked = near.withColumn("_e", eligible.cast("int")).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*A, "_e").orderBy(*order))
    )
    in_first = (F.col("_e") == 1) & (F.col("_r") <= first_limit)
    split = ranked.withColumn("bucket", F.when(in_first, F.lit(1)).otherwise(F.lit(2)))
    place_in = F.row_number().over(Window.partitionBy(*A, "domain", "bucket").orderBy(*order))
    return (
        split.withColumn("_p", place_in)
        .filter((F.col("bucket") == 1) | (F.col("_p") <= second_cap))
        .drop("_e", "_r", "_p", "domain_rank")
    )


def dedupe_canonical(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """First row per canonical url; rows without a url are all kept."""
    own = F.concat_ws("#", F.lit("#"), *[c.cast("string") for c in place(df)])
    keyed = df.withColumn("canonical_key", F.when(F.trim(text("url")) == "", own).otherwise(canonical_key("url")))
    return first_rows(keyed, [*A, "canonical_key"], order or place(df))


def exclude_seen(
    df: DataFrame, seen: DataFrame, on: tuple[str, ...] = ("analysis_id", "url"), bitmaps: DataFrame | None = None, bits: int = BITS
) -> DataFrame:
    """Rows whose key does not occur in ``seen``.

    Bitmaps of the seen keys (:mod:`.membership`) decide most new rows where they are; only
    rows that may have been seen are shuffled for the exact comparison.
    """
    return not_in_set(df, seen, list(on), bitmaps, bits)


def upsert_by_url(base: DataFrame, refined: DataFrame) -> DataFrame:
    """Refined rows replace base rows of the same url, new ones are added."""
    both = refined.withColumn("_src", F.lit(0)).unionByName(base.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return first_rows(both.filter(text("url") != ""), [*A, "url"], [F.col("_src"), *place(both)]).drop("_src")


def _similarity() -> Column:
    return F.coalesce("similarity", F.lit(0.0))


def visual_order(df: DataFrame) -> list[Column]:
    return [exact_rank(), -_similarity(), (~is_ebay("domain")).cast("int"), *place(df)]


def visual_base(df: DataFrame, limit: int = 30) -> tuple[DataFrame, DataFrame]:
    """(base, overflow): visually accepted rows by source, similarity and eBay."""
    rows = _with_domain(df)
    order = visual_order(rows)
    base = top_k(rows, A, order, limit, "title_rank")
    return base.withColumn("selection_priority", F.lit(0)), beyond_top(rows, base, A, order, limit, "title_rank")


def candidate_order(df: DataFrame) -> list[Column]:
    """Selection priority, title rank, exact match, similarity, eBay, input order."""
    return [
        F.coalesce("selection_priority", F.lit(1)),
        F.coalesce("title_rank", F.lit(10**6)),
        *visual_order(df),
    ]


def candidate_rank(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rank of every candidate, or only of the first ``limit``."""
    rows = _with_domain(df)
    order = candidate_order(rows)
    if limit is not None:
        return top_k(rows, A, order, limit)
    return rank_in_group(rows, A, order)


def title_rank(df: DataFrame, lead: Column, order: list[Column]) -> DataFrame:
    """Position of title-selected rows."""
    return rank_in_group(df, A, order, lead, "title_rank")


def split_limit(df: DataFrame, n: int, code: str, reason: str, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(first ``n`` rows, the rest as rejections)."""
    order = order or place(df)
    top = top_k(df, A, order, n)
    return top, as_rejected(beyond_top(df, top, A, order, n), code, F.lit(reason))


def keep_range(kept: DataFrame, pool: DataFrame, low: int = 8, high: int = 15) -> DataFrame:
    """Between ``low`` and ``high`` candidates per analysis.

    Too few are filled from ``pool`` (exact matches and eBay first, no canonical url
    twice), too many are cut.  Filled rows have selection priority 2.
    """
    kept, pool = _with_domain(kept), _with_domain(pool).filter(F.trim(text("url")) != "")
    kept_order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(candidate_order(kept)[:5])])
    pool_order = F.struct(
        exact_rank().cast("int").alias("k0"),
        (~is_ebay("domain")).cast("int").alias("k1"),
        F.lit(0).alias("k2"),
        F.lit(0.0).alias("k3"),
        F.lit(0).alias("k4"),
    )
    both = kept.withColumns({"_src": F.lit(0), "_o": kept_order}).unionByName(
        pool.withColumns({"_src": F.lit(1), "_o": pool_order}), allowMissingColumns=True
    )
    order = [F.col("_src"), F.col("_o"), *place(both)]
    ranked = top_k(dedupe_canonical(both, order), A, order, high, "rank")
    own = F.sum((F.col("_src") == 0).cast("int")).over(Window.partitionBy(*A))
    filled = F.col("_src") == 1
    return (
        ranked.withColumn("_own", own)
        .filter(~filled | (F.col("rank") <= low))
        .withColumn("backfilled", filled)
        .withColumn("selection_priority", F.when(filled, F.lit(2)).otherwise(F.col("selection_priority")))
        .withColumn("title_rank", F.when(filled, 10**7 + F.col("rank") - F.col("_own") - 1).otherwise(F.col("title_rank")))
        .drop("_src", "_o", "_own")
    )


def keep_range_rejected(kept: DataFrame, high: int = 15) -> DataFrame:
    """Candidates cut from the end of the kept list."""
    rows = _with_domain(kept)
    order = candidate_order(rows)
    unique = dedupe_canonical(rows, order)
    over = beyond_top(unique, top_k(unique, A, order, high), A, order, high)
    return as_rejected(over, "keep_range_max_cap", F.lit(f"вышел за лимит итогового списка (cap={high})"))


@dataclass(frozen=True)
class CrawlPolicy:
    """Limits of crawl batches and thresholds of follow-up passes."""

    first_limit: int = 20
    exact_limit: int = 12
    ebay_cap: int = 1
    domain_cap: int = 3
    realreal_cap: int = 2
    phase2_limit: int = 8
    phase2_min_items: int = 8
    phase2_min_priced: int = 8
    overflow_limit: int = 3
    overflow_min_items: int = 5
    recovery_limit: int = 8
    recovery_min_items: int = 8
    backfill_limit: int = 6
    backfill_min_items: int = 8
    refine_limit: int = 2


def _in_list(domain: Column, domains: list[str]) -> Column:
    hit = domain.isin(domains)
    for d in domains:
        hit = hit | domain.endswith("." + d)
    return hit


def crawl_order(df: DataFrame) -> list[Column]:
    d = F.col("domain")
    speed = (
        F.when(is_ebay(d) | _in_list(d, fixed.FAST_DOMAINS), F.lit(0))
        .when(_in_list(d, fixed.SLOW_DOMAINS), F.lit(2))
        .otherwise(F.lit(1))
    )
    order = candidate_order(df)
    return [speed, order[2], order[0], order[1], order[3], *place(df)]


def next_crawl_batch(cands: DataFrame, limit: int = 20, policy: CrawlPolicy = CrawlPolicy()) -> DataFrame:
    """The next ``limit`` pages to crawl per analysis.

    Rows within the domain and eBay caps come first, then the rest in order.  Only the
    head of each domain can be picked, so just these rows reach the ranking of an
    analysis: at most ``limit`` per domain.
    """
    rows = _with_domain(distinct_links(cands))
    order = crawl_order(rows)
    cap = F.when(F.col("domain").endswith("therealreal.com"), F.lit(policy.realreal_cap)).otherwise(F.lit(policy.domain_cap))
    heads = top_k(rows, [*A, "domain"], order, max(limit, policy.domain_cap, policy.realreal_cap), "_d")
    in_cap = F.col("_d") <= cap
    ebay = in_cap & is_ebay("domain")
    so_far = Window.partitionBy(*A).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    taken = F.sum(ebay.cast("int")).over(so_far)
    over = F.when(in_cap & (~ebay | (F.col("_taken") <= policy.ebay_cap)), F.lit(0)).otherwise(F.lit(1))
    marked = heads.withColumn("_taken", taken).withColumn("over_cap", over).drop("_d", "_taken")
    return top_k(marked, A, [F.col("over_cap"), *order], limit, "pick")


def first_crawl_batch(cands: DataFrame, policy: CrawlPolicy = CrawlPolicy()) -> DataFrame:
    """The pages of the first pass.

    An analysis with exact matches starts with these alone, at most ``exact_limit`` of
    them; another one starts with the first ``first_limit`` of all its candidates.
    """
    exact = exact_rank() == 0
    kinds = cands.groupBy(*A).agg((F.count_if(exact) > 0).alias("_by_exact"))
    pool = cands.join(kinds, A).filter(~F.col("_by_exact") | exact)
    picked = next_crawl_batch(pool, policy.first_limit, policy)
    return picked.filter(~F.col("_by_exact") | (F.col("pick") <= policy.exact_limit)).drop("_by_exact")


def follow_up_batch(
    cands: DataFrame,
    crawled: DataFrame,
    results: DataFrame,
    step: str,
    policy: CrawlPolicy = CrawlPolicy(),
) -> DataFrame:
    """Pages of one follow-up pass: phase2, overflow, recovery, backfill or refine.

    ``crawled`` holds the pages fetched so far (for refine with ``needs_refine``),
    ``results`` the listings they gave.  An analysis takes part when its results stay
    below the pass's thresholds.
    """
    got = results.groupBy(*A).agg(F.count(F.lit(1)).alias("_items"), F.count("price").alias("_priced"))
    done = crawled.groupBy(*A).agg(F.count_distinct("url").alias("_done"))
    if step == "refine":
        rows = crawled.filter(F.col("needs_refine"))
        return top_k(rows, A, place(rows), policy.refine_limit, "pick").withColumn("crawl_pass", F.lit(step))
    open_rows = exclude_seen(cands.filter(text("url") != ""), crawled)
    state = (
        open_rows.join(got, "analysis_id", "left")
        .join(done, "analysis_id", "left")
        .fillna(0, ["_items", "_priced", "_done"])
    )
    items, priced = F.col("_items"), F.col("_priced")
    if step == "phase2":
        # needs both kinds of candidates; the first pass and this one share one page limit
        kinds = cands.groupBy(*A).agg(
            F.count_if(exact_rank() == 0).alias("_exact"), F.count(F.lit(1)).alias("_kept")
        )
        rows = state.join(kinds, "analysis_id").filter(
            (F.col("_exact") > 0)
            & (exact_rank() == 1)
            & ((items < policy.phase2_min_items) | (priced < policy.phase2_min_priced))
        )
        left = F.least(F.col("_kept"), F.lit(policy.first_limit)) - F.col("_done")
        allowed = F.when(left > 0, F.least(left, F.lit(policy.phase2_limit))).otherwise(F.lit(policy.phase2_limit))
        picked = next_crawl_batch(rows, policy.phase2_limit, policy).filter(F.col("pick") <= allowed)
        picked = picked.drop("_exact", "_kept")
    elif step == "overflow":
        rows = state.filter(items < policy.overflow_min_items)
        picked = top_k(rows, A, place(rows), policy.overflow_limit, "pick")
    elif step == "recovery":
        picked = next_crawl_batch(state.filter(items < policy.recovery_min_items), policy.recovery_limit, policy)
    elif step == "backfill":
        picked = next_crawl_batch(state.filter(items < policy.backfill_min_items), policy.backfill_limit, policy)
    else:
        raise ValueError(f"unknown pass: {step}")
    return picked.drop("_items", "_priced", "_done").withColumn("crawl_pass", F.lit(step))
