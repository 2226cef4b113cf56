"""Queries: title keywords and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import routing as r
from ..operators import titles as t
from .fixtures import fixture
from .registry import cte, in_list, query

_STOP = in_list(fixed.TITLE_STOP_WORDS)
_ORD = "section_rank, pos, url NULLS FIRST"


def _fold(expr: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({expr}, '')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


cte(
    "tok",
    f"""SELECT *, list_filter(string_split({_fold('title')}, ' '), lambda w: length(w) >= 3 AND w NOT IN {_STOP}) AS t,
        row_number() OVER (PARTITION BY analysis_id ORDER BY {_ORD}) AS place FROM @cands""",
)
cte("doc_tok", f"SELECT *, list_filter(string_split({_fold('title')}, ' '), lambda w: length(w) >= 3 AND w NOT IN {_STOP}) AS t FROM @doc_titles")


def grams_sql(src: str, n: int) -> str:
    """(analysis_id, place, i, g): the n-word runs of src(t)."""
    return f"""SELECT * EXCLUDE (t, k), list_aggregate(t[i:i + {n - 1}], 'string_agg', ' ') AS g FROM (
        SELECT *, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT *, {n} AS k FROM {src} WHERE len(t) >= {n}))"""


@query(
    "title_ngrams",
    f"""SELECT analysis_id, CAST(2 AS INT) AS size, g AS ngram, count(*) AS count FROM ({grams_sql('@doc_tok', 2)}) GROUP BY 1, 3
        UNION ALL SELECT analysis_id, CAST(3 AS INT), g, count(*) FROM ({grams_sql('@doc_tok', 3)}) GROUP BY 1, 3""",
)
def title_ngrams(spark, d):
    return t.title_ngrams(fixture(spark, d, "doc_titles"))


@query(
    "top_terms",
    f"""SELECT analysis_id, g AS ngram, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY n DESC, g) AS r FROM (
        SELECT analysis_id, g, count(*) AS n FROM ({grams_sql('@doc_tok', 2)}) GROUP BY 1, 2)) WHERE r <= 20""",
)
def top_terms(spark, d):
    counts = t.title_ngrams(fixture(spark, d, "doc_titles"), (2,))
    return t.top_terms(counts, 20).select("analysis_id", "ngram", "count")


@query(
    "hot_terms",
    f"""SELECT analysis_id, g AS ngram, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY n DESC, g) AS r FROM (
        SELECT analysis_id, g, count(*) AS n FROM ({grams_sql('@doc_tok', 2)}) GROUP BY 1, 2)) WHERE r <= 5""",
)
def hot_terms(spark, d):
    """Sketches of two halves of the titles, merged; then exact counts of the candidates, or of all terms where these may not do."""
    rows = fixture(spark, d, "doc_titles")
    halves = [t.term_states(rows.where(F.col("pos") % 2 == k)) for k in (0, 1)]
    return t.top_terms_by_sketch(rows, 5, states=t.merged_term_states(halves[0].union(halves[1])))


cte("work", "SELECT * FROM @tok")
cte(
    "phrase_top",
    f"""SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY n DESC, f) AS r FROM (
        SELECT analysis_id, g, count(*) AS n, min((place, i)) AS f FROM ({grams_sql('@work', 2)})
        WHERE split_part(g, ' ', 1) <> split_part(g, ' ', 2) GROUP BY 1, 2) QUALIFY r <= 20""",
)
cte(
    "word_top",
    f"""SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY n DESC, f) AS r FROM (
        SELECT analysis_id, g, count(*) AS n, min((place, i)) AS f FROM ({grams_sql('@work', 1)}) GROUP BY 1, 2) QUALIFY r <= 30""",
)
cte(
    "profiles",
    """SELECT analysis_id, list(g ORDER BY k, r) AS keywords FROM (
        SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY k, r) AS kr FROM (
        SELECT analysis_id, g, 0 AS k, r FROM @phrase_top WHERE n >= 2 UNION ALL SELECT analysis_id, g, 1, r FROM @word_top))
        WHERE kr <= 10 GROUP BY 1""",
)


@query("keyword_profile", "SELECT analysis_id, array_to_string(keywords, '|') AS keywords FROM @profiles")
def keyword_profile(spark, d):
    return t.keyword_profile(fixture(spark, d, "cands")).select("analysis_id", F.array_join("keywords", "|").alias("keywords"))


def _profiles(spark, d):
    """Profiles with a brand and one negative keyword each."""
    cands = fixture(spark, d, "cands")
    brands = r.infer_brand(cands).select("analysis_id", "target_brand")
    return t.keyword_profile(cands).join(brands, "analysis_id").withColumn("negative_keywords", F.array(F.lit("plate"), F.lit("")))


cte(
    "scored",
    f"""SELECT *, CASE WHEN serp_source = 'exact_matches' THEN 6 ELSE 0 END
        + CASE WHEN target_brand IS NULL OR contains(ft, target_brand) OR contains(fu, target_brand) THEN 5 ELSE -8 END
        + list_sum(list_transform(keywords, lambda k: CASE WHEN contains(k, ' ') THEN CASE WHEN contains(ft || ' ' || fu, k) THEN 8 ELSE 0 END
            WHEN contains(' ' || ft || ' ' || fu || ' ', ' ' || k || ' ') THEN 4 ELSE 0 END))
        - CASE WHEN contains(ft || ' ' || fu, 'plate') THEN 5 ELSE 0 END AS score
        FROM (SELECT c.*, p.keywords, b.target_brand, {_fold('c.title')} AS ft, {_fold('c.url')} AS fu FROM @cands c
          JOIN @profiles p USING (analysis_id) JOIN @brand_targets b USING (analysis_id))""",
)


@query("score_keywords", "SELECT pos, CAST(score AS BIGINT) AS title_score FROM @scored")
def score_keywords(spark, d):
    out = t.score_keywords(fixture(spark, d, "cands"), _profiles(spark, d))
    return out.select("pos", F.col("title_score").cast("long").alias("title_score"))


@query(
    "title_shortlist",
    f"""SELECT pos, r AS shortlist_rank FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY score DESC,
        CASE WHEN serp_source = 'exact_matches' THEN 0 ELSE 1 END, {_ORD}) AS r FROM @scored) WHERE r <= 60""",
)
def title_shortlist(spark, d):
    out = t.title_shortlist(t.score_keywords(fixture(spark, d, "cands"), _profiles(spark, d)), 15)
    return out.select("pos", F.col("shortlist_rank").cast("long").alias("shortlist_rank"))


@query(
    "frequency_select",
    f"""WITH w AS (SELECT analysis_id, g, count(*) AS n FROM ({grams_sql('(SELECT * FROM tok)', 1)}) GROUP BY 1, 2),
        s AS (SELECT pos, sum(w.n) AS total FROM (SELECT analysis_id, pos, unnest(t) AS g FROM @tok) x JOIN w USING (analysis_id, g) GROUP BY 1)
        SELECT pos, title_rank, CAST(score AS BIGINT) AS title_score FROM (
          SELECT pos, score, row_number() OVER (PARTITION BY analysis_id ORDER BY score DESC, {_ORD}) AS title_rank FROM (
          SELECT c.* EXCLUDE (title_rank), CASE WHEN serp_source = 'exact_matches' THEN 4 ELSE 0 END + coalesce(s.total, 0)
            + CASE WHEN target_brand IS NULL OR contains({_fold('title')}, target_brand) OR contains({_fold('url')}, target_brand) THEN 3 ELSE 0 END AS score
          FROM @cands c LEFT JOIN s USING (pos) JOIN @brand_targets b USING (analysis_id))) WHERE title_rank <= 15""",
)
def frequency_select(spark, d):
    cands = fixture(spark, d, "cands").drop("title_rank")
    out = t.frequency_select(cands, r.infer_brand(cands), 15)
    return out.select("pos", F.col("title_rank").cast("long").alias("title_rank"), F.col("title_score").cast("long").alias("title_score"))


def _outside(words: str) -> str:
    return f"list_filter({words}, lambda w: NOT list_contains(b, w))"


def _once(words: str) -> str:
    """Distinct values in order; ``words`` names a column."""
    return f"list_filter({words}, lambda x, i: list_position({words}, x) = i)"


@query(
    "target_name",
    f"""WITH g AS (
        SELECT analysis_id, g, (place, i) AS f, 3 AS k FROM ({grams_sql('@work', 3)}) UNION ALL SELECT analysis_id, g, (place, i + 1000000), 2 FROM ({grams_sql('@work', 2)})
        UNION ALL SELECT analysis_id, g, (place, i), 1 FROM ({grams_sql('@work', 1)})),
        n AS (SELECT analysis_id, k = 1 AS word, g, count(*) AS n, min(f) AS f FROM g GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, word ORDER BY n DESC, f) AS r FROM n QUALIFY r <= CASE WHEN word THEN 40 ELSE 20 END),
        l AS (SELECT analysis_id, list(g ORDER BY r) FILTER (NOT word AND n >= 2) AS often, list(g ORDER BY r) FILTER (NOT word AND n < 2) AS single,
            list(g ORDER BY r) FILTER (word) AS words FROM r GROUP BY 1),
        b AS (SELECT a.analysis_id, list_filter(string_split({_fold('t.target_brand')}, ' '), lambda w: w <> '') AS b, coalesce(l.often, []) AS often,
            coalesce(l.single, []) AS single, coalesce(l.words, []) AS words, coalesce(p.keywords, []) AS keywords
            FROM (SELECT DISTINCT analysis_id FROM @work) a LEFT JOIN l USING (analysis_id) LEFT JOIN @brand_targets t USING (analysis_id) LEFT JOIN @profiles p USING (analysis_id)),
        c AS (SELECT *, flatten(list_transform(often, lambda g: {_outside("string_split(g, ' ')")})) AS o,
            coalesce({_outside("string_split(list_filter(single, lambda g: len(" + _outside("string_split(g, ' ')") + ") > 0)[1], ' ')")}, []) AS s,
            list_filter(flatten(list_transform(keywords, lambda h: string_split(h, ' '))), lambda w: length(w) >= 3 AND w NOT IN {_STOP}) AS h FROM b),
        d AS (SELECT *, CASE WHEN len(o) > 0 THEN o ELSE s END AS ph FROM c),
        e AS (SELECT *, list_concat(({_once('ph')})[1:4], {_outside('words')}) AS m FROM d),
        m AS (SELECT *, list_concat(b, {_outside('h')}, ({_once('m')})[1:4]) AS every FROM e),
        o AS (SELECT *, list_filter({_once('every')}, lambda w: w <> '' AND w NOT IN {_STOP})[1:len(b) + 4] AS o2 FROM m)
        SELECT analysis_id, CASE WHEN len(o2) >= CASE WHEN len(b) > 0 THEN 1 ELSE 2 END THEN
            array_to_string(list_transform(o2, lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') END AS target_name FROM o""",
)
def target_name(spark, d):
    cands = fixture(spark, d, "cands")
    return t.target_name(cands, r.infer_brand(cands), t.keyword_profile(cands))


@query(
    "merge_votes",
    """SELECT analysis_id, coalesce(array_to_string(list(term ORDER BY r) FILTER (kind = 'keyword' AND r <= 10), '|'), '') AS keywords,
        coalesce(array_to_string(list(term ORDER BY r) FILTER (kind = 'negative' AND r <= 5), '|'), '') AS negatives,
        any_value(term) FILTER (kind = 'name' AND r = 1) AS target_name FROM (
        SELECT *, row_number() OVER (PARTITION BY analysis_id, kind ORDER BY n DESC, f, term) AS r FROM (
        SELECT p_brand AS analysis_id, kind, term, count(*) AS n, min((chunk, pos)) AS f FROM (
          SELECT p_brand, p_partkey % 4 AS chunk, p_partkey AS pos, CASE p_size % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'negative' ELSE 'name' END AS kind,
            CASE p_size % 3 WHEN 2 THEN p_type ELSE p_name END AS term FROM {part}) GROUP BY 1, 2, 3)) GROUP BY 1""",
)
def merge_votes(spark, d):
    from .fixtures import load

    kind = F.element_at(F.array(F.lit("keyword"), F.lit("negative"), F.lit("name")), F.col("p_size") % 3 + 1)
    votes = load(spark, d, "part").select(
        F.col("p_brand").alias("analysis_id"), (F.col("p_partkey") % 4).alias("chunk"), F.col("p_partkey").alias("pos"),
        kind.alias("kind"), F.when(F.col("p_size") % 3 == 2, F.col("p_type")).otherwise(F.col("p_name")).alias("term"),
    )
    out = t.merge_votes(votes)
    return out.select(
        "analysis_id", F.array_join("keywords", "|").alias("keywords"), F.array_join("negative_keywords", "|").alias("negatives"), "target_name"
    )
