"""Frequent title terms from sketches against full counts."""

from __future__ import annotations

from tagworth.operators import titles as t


def titles(spark):
    flat = [("flat", f"alpha{i:03d} omega{i:03d}") for i in range(400)]
    skewed = [("skewed", "scarlet velvet")] * 50 + [("skewed", f"indigo{i:03d} velvet") for i in range(150)]
    return spark.createDataFrame([*flat, *skewed, ("single", "one"), ("none", None)], "analysis_id string, title string")


def test_sketches_say_where_they_are_sure(spark):
    hot = {(r.analysis_id, r.ngram, r["count"]): r.sure for r in t.hot_terms(titles(spark), 1, tracked=512).collect()}
    assert hot[("skewed", "scarlet velvet", 50)] is True
    assert [sure for (key, _, _), sure in hot.items() if key == "flat"] == [False]


def test_unsure_analyses_are_counted_in_full(spark):
    df = titles(spark)
    rows = {tuple(r) for r in t.top_terms_by_sketch(df, 1, tracked=512).collect()}
    assert rows == {tuple(r) for r in t.top_terms(t.title_ngrams(df, (2,)), 1).select("analysis_id", "ngram", "count").collect()}
    assert ("flat", "alpha000 omega000", 1) in rows


def test_states_of_parts_merge(spark):
    df = titles(spark)
    states = t.merged_term_states(t.term_states(df, tracked=512).union(t.term_states(df.limit(0), tracked=512)), tracked=512)
    assert t.hot_terms(df, 1, states=states, tracked=512).count() == 2


def test_titles_are_counted_once_each_and_ties_go_to_the_first_use(spark):
    from pyspark.sql import functions as F

    from tagworth.operators import titles

    rows = [("a", 0, 7, "u2", "second words"), ("a", 0, 7, "u1", "first words"), ("a", 1, None, "u3", "early"), ("a", 0, 9, "u4", None)]
    df = spark.createDataFrame(rows, "analysis_id string, section_rank int, pos bigint, url string, title string")
    df = df.withColumn("serp_source", F.lit("visual_matches"))
    assert titles.keyword_profile(df, limit=4).first()["keywords"] == ["words", "first", "second", "early"]
    shared = df.withColumn("url", F.lit("u")).where("title IS NOT NULL AND pos = 7")
    brands = spark.createDataFrame([("a", None)], "analysis_id string, target_brand string")
    more = shared.unionByName(df.where("pos = 9").withColumn("title", F.lit("first first")))
    scores = {r["title"]: r["title_score"] for r in titles.frequency_select(more, brands, 9).collect()}
    assert scores == {"first words": 3 + 3 + 2, "second words": 3 + 1 + 2, "first first": 3 + 6}
    plan = titles._distinct_titles(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_targets_are_made_before_candidates_meet_them(spark):
    from tagworth.operators import routing

    rows = [("a", 0, 1, "https://www.ebay.com/itm/1", "chanel bag", "visual_matches")] * 3
    df = spark.createDataFrame(rows, "analysis_id string, section_rank int, pos bigint, url string, title string, serp_source string")
    routed = routing.routed(df, routing.infer_brand(df))
    assert {(r["target_brand"], r["reason_code"]) for r in routed.collect()} == {("chanel", None)}
    assert "Aggregate" not in routed._jdf.queryExecution().optimizedPlan().toString()


def test_letters_fold_to_ascii_without_a_class_of_all_long_ones(spark):
    """Every code point folds as Unicode says; the letters that become several are looked up, not tried one by one."""
    import unicodedata

    from pyspark.sql import functions as F

    from tagworth.functions import words

    known = set(words._FOLD_FROM) | set(words._FOLD_LONG)
    points = [chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0xFFFE), 0x1F600]]
    df = spark.createDataFrame([(f"a{p}\u00e9\u2122",) for p in points], "c string")
    out = [r[0] for r in df.select(words.fold_ascii(F.col("c"))).collect()]
    fold = lambda p: unicodedata.normalize("NFKD", p).encode("ascii", "ignore").decode() if p in known else p if p < "\x80" else ""
    assert out == [f"a{fold(p)}eTM" for p in points]
    assert "RLIKE(c, [" + "".join(words._FOLD_LONG)[:2] not in df.select(words.fold_ascii(F.col("c")))._jdf.queryExecution().analyzed().toString()
