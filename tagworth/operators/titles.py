"""Title keywords: n-grams, profiles, scores and selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.base import let, text
from ..functions.words import brand_token_ascii, has_brand, ngrams, title_tokens
from .groups import staged, top_k
from .routing import exact_rank, place

A = ["analysis_id"]


def title_ngrams(df: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Frequency of word runs in titles: analysis, size, ngram, count."""
    tokens = df.select("analysis_id", title_tokens("title").alias("_t"))

    def sized(n: int) -> Column:
        return F.transform(ngrams(F.col("_t"), n), lambda g: F.struct(F.lit(n).alias("size"), g.alias("ngram")))

    grams = F.concat(*[sized(n) for n in sizes])
    return tokens.select("analysis_id", F.inline(grams)).groupBy("analysis_id", "size", "ngram").agg(F.count(F.lit(1)).alias("count"))


def top_terms(counts: DataFrame, n: int, keys: list[str] = A, term: str = "ngram", ties: list[Column] | None = None) -> DataFrame:
    """The ``n`` most frequent terms per key; ties by ``ties`` or by the term."""
    return top_k(counts, keys, [-F.col("count"), *(ties or [F.col(term)])], n)


def _title_runs(df: DataFrame, size: int) -> DataFrame:
    """A row per run of ``size`` title words; words are cut before runs are formed, once per title."""
    tokens = df.select("analysis_id", title_tokens("title").alias("_t"))
    return tokens.select("analysis_id", F.explode(ngrams(F.col("_t"), size)).alias("ngram"))


def term_states(df: DataFrame, size: int = 2, tracked: int = 20_000) -> DataFrame:
    """``analysis_id, state``: mergeable sketches of the most frequent runs of ``size`` title words."""
    terms = _title_runs(df, size)
    return terms.groupBy("analysis_id").agg(F.expr(f"approx_top_k_accumulate(ngram, {int(tracked)})").alias("state"))


def merged_term_states(states: DataFrame, tracked: int = 20_000) -> DataFrame:
    """States of several parts of the titles as one per analysis."""
    return states.groupBy("analysis_id").agg(F.expr(f"approx_top_k_combine(state, {int(tracked)})").alias("state"))


def hot_terms(df: DataFrame, n: int, size: int = 2, states: DataFrame | None = None, tracked: int = 20_000) -> DataFrame:
    """The ``n`` most frequent terms per analysis, with few counts shuffled.

    Sketches name candidates, a few times as many as wanted, and a second pass counts these
    exactly.  ``sure`` is true where the result is that of :func:`top_terms` over
    :func:`title_ngrams`: no term beyond the candidates can have the count of the
    last one, since its estimate, an upper bound, is below.  ``states`` may be kept from
    earlier parts of the same titles.
    """
    wanted = 8 * n + 100
    if wanted > tracked // 2:
        raise ValueError("tracked must be sixteen times n at least")
    states = term_states(df, size, tracked) if states is None else states
    named = states.select("analysis_id", F.expr(f"approx_top_k_estimate(state, {wanted})").alias("e"))
    bounds = named.select("analysis_id", F.when(F.size("e") >= wanted, F.array_min(F.transform("e", lambda x: x["count"]))).alias("_bound"))
    candidates = named.select("analysis_id", F.explode("e").alias("x")).select("analysis_id", F.col("x.item").alias("ngram"))
    terms = _title_runs(df, size)
    counts = terms.join(F.broadcast(candidates), ["analysis_id", "ngram"]) if small_enough(candidates) else terms.join(candidates, ["analysis_id", "ngram"])
    exact = counts.groupBy("analysis_id", "ngram").agg(F.count(F.lit(1)).alias("count"))
    top = top_terms(exact, n)
    last = top.groupBy("analysis_id").agg(F.min("count").alias("_last"), F.count(F.lit(1)).alias("_found"))
    told = last.join(bounds, "analysis_id").select(
        "analysis_id", (F.col("_bound").isNull() | ((F.col("_found") >= n) & (F.col("_last") > F.col("_bound")))).alias("sure")
    )
    return top.join(told, "analysis_id")


def top_terms_by_sketch(df: DataFrame, n: int, size: int = 2, states: DataFrame | None = None, tracked: int = 20_000) -> DataFrame:
    """The rows of :func:`hot_terms` where they are sure; the other analyses are counted in full."""
    hot = hot_terms(df, n, size, states, tracked)
    unsure = hot.where(~F.col("sure")).select("analysis_id").distinct()
    rest = top_terms(title_ngrams(df.join(unsure, "analysis_id", "left_semi"), (size,)), n)
    columns = ["analysis_id", "ngram", "count"]
    return hot.where("sure").select(columns).unionByName(rest.select(columns))


def small_enough(rows: DataFrame, most: int = 500_000) -> bool:
    """Whether a table has at most ``most`` rows; counts no more than it must."""
    return rows.limit(most + 1).count() <= most


def _pool(df: DataFrame, pool: int | None) -> DataFrame:
    """All rows, or with ``pool`` only the first of each analysis."""
    return df if pool is None else top_k(df, A, place(df), pool, "_rank")


def _lead(df: DataFrame) -> list[Column]:
    """Section and position of a row as numbers; a missing position comes first, as in :func:`place`."""
    pos = F.col("pos") if "pos" in df.columns else F.lit(0)
    section = F.col("section_rank") if "section_rank" in df.columns else F.lit(0)
    return [section.alias("_s"), pos.isNotNull().alias("_k"), pos.alias("_p")]


def _distinct_titles(rows: DataFrame) -> DataFrame:
    """Each title of an analysis and section once: ``_n`` rows have it, ``_p`` is its first position.

    All values are numbers, which Spark merges in its hash tables, without a sort of the rows.
    """
    led = rows.select("analysis_id", "title", *_lead(rows))
    return led.groupBy("analysis_id", "title", "_s", "_k").agg(F.min("_p").alias("_p"), F.count(F.lit(1)).alias("_n"))


def _top_lists(rows: DataFrame, lists: dict[str, tuple[Callable[[Column], Column], int]]) -> DataFrame:
    """``analysis_id`` and a list of ``_r, term, count`` per name: the most frequent terms, ties by first use.

    ``lists`` has for a name the terms of a title's words and how many are wanted.  Words
    are cut and counted once per distinct title.  Section and position of their first use
    leave few candidates, whose urls and places in the title are then read from the rows there.
    """

    def used(titles: DataFrame, *columns: str) -> DataFrame:
        entry = lambda name: lambda t, i: F.struct(F.lit(name).alias("kind"), t.alias("term"), i.alias("_i"))
        cut = titles.withColumn("_t", title_tokens("title"))
        return cut.select("analysis_id", *columns, F.inline(F.concat(*[F.transform(f(F.col("_t")), entry(k)) for k, (f, _) in lists.items()])))

    key = ["analysis_id", "kind", "term"]
    by_section = used(_distinct_titles(rows), "_s", "_k", "_p", "_n").groupBy(*key, "_s", "_k").agg(F.sum("_n").alias("count"), F.min("_p").alias("_p"))
    counts = by_section.groupBy(*key).agg(F.sum("count").alias("count"), F.min(F.struct("_s", "_k", "_p")).alias("_lead"))
    wanted = F.lit(0)
    for name, (_, n) in lists.items():
        wanted = F.when(F.col("kind") == name, n).otherwise(wanted)
    most = max(n for _, n in lists.values())
    w = Window.partitionBy("analysis_id", "kind")
    ranked = counts.withColumn("_near", F.rank().over(w.orderBy(-F.col("count"), "_lead")))
    near = staged(ranked.where((F.col("_near") <= most) & (F.col("_near") <= wanted)).drop("_near"))
    there = rows.select("analysis_id", "title", F.struct(*_lead(rows)).alias("_lead"), F.struct(*place(rows)).alias("_at"))
    leads = near.select(F.col("analysis_id").alias("_a"), F.col("_lead").alias("_l"))
    first_rows = there.join(leads, (F.col("analysis_id") == F.col("_a")) & F.col("_lead").eqNullSafe(F.col("_l")), "left_semi")
    near = near.select(*[F.col(c).alias("_" + c) for c in key], "count", F.col("_lead").alias("_l"))
    same = F.col("_lead").eqNullSafe(F.col("_l"))
    for c in key:
        same &= F.col(c) == F.col("_" + c)
    uses = used(first_rows, "_lead", "_at").join(near, same)
    exact = uses.groupBy(*key).agg(F.max("count").alias("count"), F.min(F.struct("_at", "_i")).alias("first"))
    top = exact.withColumn("_r", F.row_number().over(w.orderBy(-F.col("count"), "first"))).where(F.col("_r") <= wanted)
    entry = F.struct("_r", "term", "count")
    return top.groupBy(*A).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))).alias(k) for k in lists])


def _terms(c: str | Column) -> Column:
    return F.coalesce(F.col(c)["term"] if isinstance(c, str) else c["term"], F.array().cast("array<string>"))


def keyword_profile(df: DataFrame, limit: int = 10, pool: int | None = None) -> DataFrame:
    """Keywords of an analysis: repeated two-word phrases, then frequent words.

    All titles count; ``pool`` restricts the counts to the first titles of an analysis.
    """
    rows = _pool(df, pool)
    unequal = lambda t: F.filter(ngrams(t, 2), lambda p: F.substring_index(p, " ", 1) != F.substring_index(p, " ", -1))
    lists = _top_lists(rows, {"_phrases": (unequal, limit * 2), "_words": (lambda t: t, limit * 3)})
    joined = rows.select("analysis_id").distinct().join(lists, "analysis_id", "left")
    repeated = F.filter("_phrases", lambda p: p["count"] >= 2)
    keywords = F.slice(F.array_distinct(F.concat(_terms(repeated), _terms("_words"))), 1, limit)
    return joined.select("analysis_id", keywords.alias("keywords"))


def target_name(
    df: DataFrame,
    brands: DataFrame | None = None,
    profiles: DataFrame | None = None,
    max_tokens: int = 4,
    sample: int | None = None,
    stop_words: list[str] = fixed.TITLE_STOP_WORDS,
) -> DataFrame:
    """Readable model name from brand, keyword hints and frequent title words."""
    rows = _pool(df, sample)
    grams = lambda t: F.concat(ngrams(t, 3), ngrams(t, 2))
    lists = _top_lists(rows, {"_phrases": (grams, 20), "_words": (lambda t: t, 40)})
    base = rows.select("analysis_id").distinct().join(lists, "analysis_id", "left")
    none = F.array().cast("array<string>")
    base = base.withColumn("target_brand", F.lit(None).cast("string")) if brands is None else base.join(
        brands.select("analysis_id", "target_brand"), "analysis_id", "left"
    )
    base = base.withColumn("keywords", none) if profiles is None else base.join(
        profiles.select("analysis_id", "keywords"), "analysis_id", "left"
    )
    brand = F.filter(F.split(brand_token_ascii("target_brand"), " "), lambda w: w != "")
    hints = F.flatten(F.transform(F.coalesce("keywords", none), lambda h: title_tokens(h)))
    prepared = base.withColumn("_b", brand).withColumn("_h", hints)
    outside = lambda words: F.filter(words, lambda w: ~F.array_contains("_b", w))
    parts = lambda entries: F.flatten(F.transform(_terms(entries), lambda p: outside(F.split(p, " "))))
    phrases_col = F.coalesce("_phrases", F.expr("array()").cast("array<struct<_r:int,term:string,count:bigint>>"))
    often = parts(F.filter(phrases_col, lambda p: p["count"] >= 2))
    usable = lambda p: F.size(outside(F.split(p["term"], " "))) > 0
    once = parts(F.slice(F.filter(phrases_col, lambda p: (p["count"] < 2) & usable(p)), 1, 1))
    from_phrases = F.slice(F.array_distinct(F.when(F.size(often) > 0, often).otherwise(once)), 1, max_tokens)
    model = F.slice(F.array_distinct(F.concat(from_phrases, outside(_terms("_words")))), 1, max_tokens)
    merged = F.filter(
        F.array_distinct(F.concat(F.col("_b"), outside(F.col("_h")), model)), lambda w: (w != "") & ~w.isin(stop_words)
    )
    ordered = F.slice(merged, 1, F.size("_b") + max_tokens)
    pretty = lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.initcap(w))
    enough = lambda o: F.size(o) >= F.when(F.size("_b") > 0, F.lit(1)).otherwise(F.lit(2))
    name = let(ordered, lambda o: F.when(enough(o), F.array_join(F.transform(o, pretty), " ")))
    return prepared.select("analysis_id", name.alias("target_name"))


def score_keywords(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Score of every candidate against its analysis' profile.

    ``profiles`` has ``analysis_id, target_brand, keywords, negative_keywords``.  Single
    words match whole words only.
    """
    none = F.array().cast("array<string>")
    pad = lambda k: F.concat(F.lit(" "), k, F.lit(" "))

    def gain(k: Column) -> Column:
        phrase = k.contains(" ")
        return F.struct(
            phrase.alias("phrase"), F.when(phrase, k).otherwise(pad(k)).alias("needle"), F.when(phrase, 8).otherwise(4).alias("points")
        )

    # few rows of known size: every candidate meets its profile where it is
    wanted = staged(
        profiles.select(
            "analysis_id", (text("target_brand") != "").alias("_branded"), brand_token_ascii("target_brand").alias("_brand"),
            F.transform(F.filter(F.coalesce("keywords", none), lambda k: k != ""), gain).alias("_gains"),
            F.filter(F.coalesce("negative_keywords", none), lambda n: n != "").alias("_negative"),
        )
    )
    folded = df.join(wanted, "analysis_id", "left").withColumns({"_ft": brand_token_ascii("title"), "_fu": brand_token_ascii("url")})
    joined = folded.withColumn("_words", F.concat_ws(" ", "_ft", "_fu")).withColumn("_padded", pad(F.col("_words")))
    held = lambda g: F.when(g["phrase"], F.col("_words")).otherwise(F.col("_padded")).contains(g["needle"])
    plus = F.aggregate("_gains", F.lit(0), lambda acc, g: acc + F.when(held(g), g["points"]).otherwise(0))
    minus = F.size(F.filter("_negative", lambda n: F.col("_words").contains(n))) * 5
    known = F.coalesce("_brand", F.lit(""))
    has = (known == "") | F.col("_ft").contains(known) | F.col("_fu").contains(known)
    brand = F.when(has, 5).when(F.col("_branded"), -8).otherwise(0)
    score = F.when(exact_rank() == 0, 6).otherwise(0) + brand + F.coalesce(plus, F.lit(0)) - F.when(F.col("_negative").isNull(), 0).otherwise(minus)
    return joined.withColumn("title_score", score).drop("_branded", "_brand", "_gains", "_negative", "_ft", "_fu", "_words", "_padded")


def title_shortlist(scored: DataFrame, keep: int, minimum: int = 60) -> DataFrame:
    """Best rows by score, exact match and input order."""
    order = [-F.col("title_score"), exact_rank(), *place(scored)]
    return top_k(scored, A, order, max(keep, minimum), "shortlist_rank")


def frequency_select(df: DataFrame, brands: DataFrame, keep: int, sample: int | None = None) -> DataFrame:
    """Selection without a profile: words that are frequent in the analysis weigh most.

    All titles count; ``sample`` restricts the counts to the first of an analysis.  Words
    of distinct titles meet their counts in a join, so the vocabulary of an analysis may be of any size.
    """
    counted = _distinct_titles(_pool(df, sample)).select("analysis_id", "_n", F.explode(title_tokens("title")).alias("term"))
    counts = counted.groupBy("analysis_id", "term").agg(F.sum("_n").alias("count"))
    titles = df.select("analysis_id", "title").distinct()
    terms = titles.select("analysis_id", "title", F.explode(title_tokens("title")).alias("term"))
    totals = terms.join(counts, ["analysis_id", "term"]).groupBy("analysis_id", "title").agg(F.sum("count").alias("_total"))
    wanted = staged(brands.select("analysis_id", "target_brand"))
    joined = df.join(staged(totals), ["analysis_id", "title"], "left").join(wanted, "analysis_id", "left")
    total = F.coalesce("_total", F.lit(0))
    score = (
        F.when(exact_rank() == 0, 4).otherwise(0) + F.when(has_brand("title", "url", "target_brand"), 3).otherwise(0) + total
    )
    scored = joined.withColumn("title_score", score).drop("_total", "target_brand")
    return top_k(scored, A, [-F.col("title_score"), *place(df)], keep, "title_rank")


def merge_votes(votes: DataFrame, limit: int = 10) -> DataFrame:
    """Keywords, negatives and name voted by the chunks of an analysis.

    ``votes`` has ``analysis_id, chunk, pos, kind, term`` with kind keyword, negative or
    name; more votes first, then earlier ones.
    """
    counts = votes.groupBy("analysis_id", "kind", "term").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("chunk", "pos")).alias("first")
    )
    top = top_k(counts, ["analysis_id", "kind"], [-F.col("count"), F.col("first"), F.col("term")], max(limit, 3), "_r")
    listed = lambda kind, n: F.slice(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_r", "term")))), 1, n
    )["term"]
    return top.groupBy("analysis_id").agg(
        listed("keyword", limit).alias("keywords"),
        listed("negative", max(3, limit // 2)).alias("negative_keywords"),
        F.try_element_at(listed("name", 1), F.lit(1)).alias("target_name"),
    )
