"""Queries: search payloads, routing, merging, caps and ranking of candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import urls, words
from ..operators import candidates as c
from ..operators import membership
from ..operators import routing as r
from ..sources import search
from ..sources.dims import brand_dim
from .fixtures import fixture, load
from .registry import cte, in_list, mapping, query, rnd

_ORD = "section_rank, pos, url"


def _padded(expr: str) -> str:
    return f"' ' || trim(regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _brand_case(expr: str) -> str:
    arms = " ".join(f"WHEN contains({expr}, ' {a} ') THEN '{b}'" for a, b in words.brand_aliases())
    return f"CASE {arms} END"


cte(
    "branded",
    f"""SELECT *, coalesce({_brand_case('pt')}, {_brand_case('pu')}) AS brand FROM (
        SELECT *, {_padded('title')} AS pt, {_padded('url')} AS pu FROM @cands)""",
)
cte(
    "votes",
    f"""SELECT analysis_id, brand, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id
        ORDER BY CASE WHEN serp_source = 'exact_matches' THEN 0 ELSE 1 END, {_ORD}) AS rn FROM @branded)
        GROUP BY 1, 2""",
)
cte(
    "brand_targets",
    f"""SELECT *, CASE WHEN winner_count >= 3 AND winner_count / known_brand_hits >= 0.55 THEN best END AS target_brand,
        CASE WHEN best IS NULL THEN 'auto_no_brand_found' WHEN winner_count >= 3 AND winner_count / known_brand_hits >= 0.55
             THEN 'auto_inferred' ELSE 'auto_weak_signal' END AS mode,
        {rnd('winner_count / known_brand_hits', 3)} AS winner_ratio
        FROM (SELECT analysis_id, CAST(coalesce(sum(n) FILTER (brand IS NOT NULL), 0) AS BIGINT) AS known_brand_hits,
              max(n) FILTER (brand IS NOT NULL) AS winner_count,
              arg_max(brand, (n, brand)) FILTER (brand IS NOT NULL) AS best FROM @votes GROUP BY 1)""",
)

_BRANDS, _WORDS = in_list(fixed.BRAND_SLUGS), in_list(fixed.BRAND_SLUGS + fixed.CATEGORY_SLUGS)


def product_page_sql() -> str:
    """Product-page rules over columns u (lower url), p, lp (paths), last, prev, depth, sl, domain."""

    def has(*parts: str) -> str:
        return "(" + " OR ".join(f"contains(u, '{x}')" for x in parts) + ")"

    def starts(*parts: str) -> str:
        return "(" + " OR ".join(f"starts_with(p, '{x}')" for x in parts) + ")"

    return f"""CASE WHEN u = '' THEN FALSE
        WHEN starts_with(domain, 'ebay.') THEN CASE WHEN {has('/itm/', '/p/')} THEN TRUE
            WHEN {has('/b/', '/sch/', '/e/')} OR lp = '/shop' OR starts_with(lp, '/shop/') THEN FALSE ELSE TRUE END
        WHEN domain = 'poshmark.com' THEN CASE WHEN contains(lp, '/listing/') THEN last <> '{fixed.BLOCKED_LISTING_SLUGS[0]}'
            WHEN {has('/browse/', '/category/', '/brand/', '/search')} THEN FALSE ELSE TRUE END
        WHEN domain = 'vestiairecollective.com' THEN CASE WHEN regexp_matches(p, '[-/][0-9]+[.]shtml$') THEN TRUE
            WHEN last IN {_WORDS} THEN FALSE WHEN depth >= 2 AND prev IN {_BRANDS} THEN FALSE
            WHEN ends_with(p, '/') AND depth <= 4 THEN FALSE WHEN depth <= 2 THEN FALSE ELSE TRUE END
        WHEN domain = 'rebag.com' THEN NOT ({has('/curation/')} OR p IN ('/shop', '/shop/'))
        WHEN domain = 'theluxurycloset.com' THEN NOT ({starts('/women/', '/men/', '/bags/', '/shoes/', '/accessories/', '/jewelry/', '/watches/')} AND sl <= 2)
        WHEN domain = 'fashionphile.com' THEN {has('/products/')}
        WHEN domain = 'jolicloset.com' THEN regexp_matches(last, '--[0-9]{{4,}}$')
        WHEN domain = 'yoogiscloset.com' THEN CASE WHEN {has('/bags/', '/designers/', '/sale/')} AND sl <= 3 THEN FALSE
            ELSE regexp_matches(p, '/[0-9]+') OR sl > 2 END
        WHEN domain = 'therealreal.com' THEN CASE
            WHEN {has('/designers/', '/categories/', '/women/handbags', '/men/', '/jewelry/', '/watches/')} THEN {has('/products/')} AND depth >= 5
            WHEN last IN {_WORDS} THEN FALSE ELSE {has('/products/')} AND depth >= 4 END
        WHEN domain = 'celebrityowned.com' THEN NOT (p IN ('/shop', '/shop/') OR {has('/collections/')}) AND sl > 1
        WHEN domain = 'aretrotale.com' THEN NOT ({starts('/en-row/', '/en/')} AND sl <= 3) AND NOT {has('/collections/')}
        WHEN domain IN ('dallasdesignerhandbags.com', 'annsfabulousfinds.com') THEN NOT ({has('/collections/')} AND sl <= 3) AND sl > 1
        WHEN domain = 'popchill.com' THEN NOT ({starts('/zh-TW', '/en')} AND sl <= 2) AND NOT {has('/collections/')}
        WHEN domain = 'designerexchange.com' THEN NOT ({starts('/uk/', '/us/')} AND sl <= 3) AND NOT {has('/collections/')}
        ELSE last NOT IN {_WORDS} AND depth > 1 END"""


URL_PARTS = """SELECT *, coalesce(segs[-1], '') AS last, coalesce(segs[-2], '') AS prev, len(segs) AS depth,
    len(p) - len(replace(p, '/', '')) AS sl FROM (
    SELECT *, lower(p) AS lp, list_filter(string_split(lower(p), '/'), lambda x: x <> '') AS segs FROM (
    SELECT *, lower(coalesce(url, '')) AS u, regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM {src}))"""

cte(
    "routed",
    f"""SELECT *, {mapping('domain', fixed.SITE_BY_DOMAIN, 'domain')} AS site,
        CASE WHEN brand IS NOT NULL AND target_brand IS NOT NULL AND brand <> target_brand THEN 'brand_gate_mismatch'
             WHEN domain NOT IN {in_list(fixed.SITE_BY_DOMAIN)} THEN 'unsupported_domain'
             WHEN NOT {product_page_sql()} THEN 'catalog_page' END AS reason_code,
        CASE WHEN last IN ('chanel', 'gucci', 'louis-vuitton', 'prada', 'dior', 'hermes') THEN 'заканчивается на бренд ''' || last || ''''
             WHEN last IN ('bags', 'handbags', 'women', 'men', 'shoes', 'accessories') THEN 'заканчивается на категорию ''' || last || ''''
             WHEN depth <= 2 THEN 'короткий путь (' || depth || ' уровня)' ELSE 'не содержит ID товара' END AS detail
        FROM ({URL_PARTS.replace('{src}', '(SELECT b.*, t.target_brand FROM @branded b LEFT JOIN @brand_targets t USING (analysis_id) WHERE url IS NOT NULL)')})""",
)


@query("brand_of", "SELECT pos, brand FROM @branded")
def brand_of(spark, d):
    return fixture(spark, d, "cands").select("pos", words.brand_of("title", "url").alias("brand"))


@query("detect_brand", f"SELECT pos, {_brand_case('pt')} AS brand FROM @branded")
def detect_brand(spark, d):
    cands = fixture(spark, d, "cands").select("pos", "title")
    return r.detect_brand(cands, "title", brand_dim(spark), ["pos"]).select("pos", "brand")


@query(
    "infer_brand",
    "SELECT analysis_id, target_brand, mode, known_brand_hits, winner_count, winner_ratio FROM @brand_targets",
)
def infer_brand(spark, d):
    return r.infer_brand(fixture(spark, d, "cands"))


@query(
    "brand_gate",
    """SELECT pos FROM @branded b LEFT JOIN @brand_targets t USING (analysis_id)
       WHERE brand IS NULL OR target_brand IS NULL OR brand = target_brand""",
)
def brand_gate(spark, d):
    cands = fixture(spark, d, "cands")
    return r.brand_gate(cands, r.infer_brand(cands)).select("pos")


@query("route_kept", "SELECT pos, site, brand AS detected_brand FROM @routed WHERE reason_code IS NULL")
def route_kept(spark, d):
    cands = fixture(spark, d, "cands")
    return r.route_candidates(cands, r.infer_brand(cands))[0].select("pos", "site", "detected_brand")


@query(
    "route_rejected",
    """SELECT analysis_id, url, title, site, reason_code, CASE reason_code
        WHEN 'brand_gate_mismatch' THEN 'не совпал бренд (ожидался ' || target_brand || ', найден ' || brand || ')'
        WHEN 'catalog_page' THEN 'каталог/категория (' || detail || ')'
        ELSE 'неподдерживаемый домен (' || domain || ')' END AS reason FROM @routed WHERE reason_code IS NOT NULL""",
)
def route_rejected(spark, d):
    cands = fixture(spark, d, "cands")
    return r.route_candidates(cands, r.infer_brand(cands))[1].drop("evidence")


@query(
    "is_product_page",
    f"SELECT pos, {product_page_sql()} AS product_page FROM ({URL_PARTS.replace('{src}', '@cands')})",
)
def is_product_page(spark, d):
    return fixture(spark, d, "cands").select("pos", urls.is_product_page("url").alias("product_page"))


@query(
    "likely_sold",
    """SELECT orderkey, linenumber, partkey, suppkey, contains(u, '/sold/') OR contains(u, 'status=sold') OR contains(lower(t), 'sold listing') AS sold
       FROM (SELECT *, CASE WHEN url IS NULL THEN '' ELSE lower(url) || '?status=' || lower(split_part(coalesce(status, 'x'), ' ', 1)) END AS u,
             CASE WHEN url IS NULL THEN '' ELSE title || CASE WHEN linenumber = 2 THEN ' Sold listing' ELSE '' END END AS t FROM @listings)""",
)
def likely_sold(spark, d):
    rows = fixture(spark, d, "listings").withColumn(
        "u", F.concat("url", F.lit("?status="), F.lower(F.split(F.coalesce("status", F.lit("x")), " ")[0]))
    )
    title = F.concat("title", F.when(F.col("linenumber") == 2, F.lit(" Sold listing")).otherwise(F.lit("")))
    return rows.select("orderkey", "linenumber", "partkey", "suppkey", urls.likely_sold("u", title).alias("sold"))


# --- payloads ---------------------------------------------------------------------------

cte(
    "payload_rows",
    """SELECT CAST(orderkey AS VARCHAR) AS analysis_id, section_rank,
        row_number() OVER (PARTITION BY orderkey, section_rank ORDER BY pos, url NULLS FIRST, title, printf('$%.2f', price_original)) - 1 AS pos,
        serp_source, coalesce(url, '') AS url, title, domain, quantity, price_original FROM @listings""",
)


def payloads(spark, d):
    """One search payload per order; an order holds a handful of lines."""
    rows = fixture(spark, d, "listings").select(
        F.col("orderkey").cast("string").alias("analysis_id"),
        "serp_source",
        F.struct(
            "pos",
            F.struct(
                F.col("url").alias("link"),
                F.col("title"),
                F.format_string("$%.2f", "price_original").alias("price"),
            ).alias("item"),
        ).alias("entry"),
    )
    lists = rows.groupBy("analysis_id").agg(
        *[
            F.transform(F.array_sort(F.collect_list(F.when(F.col("serp_source") == s, F.col("entry")))), lambda e: e["item"]).alias(s)
            for s in ("exact_matches", "visual_matches", "organic_results", "shopping_results")
        ]
    )
    return lists.select(
        "analysis_id",
        F.to_json(F.struct("exact_matches", "visual_matches", "organic_results", "shopping_results")).alias("payload"),
    )


_SUPPORTED = in_list(fixed.SITE_BY_DOMAIN)


@query(
    "search_results",
    f"""SELECT analysis_id, url, arg_min(title, (section_rank, pos)) AS title, arg_min(serp_source, (section_rank, pos)) AS serp_source,
        arg_min(price_original, (section_rank, pos)) AS serp_price, 'USD' AS serp_currency,
        array_to_string(list_distinct(list(serp_source ORDER BY section_rank, pos)), '') <> '' AS has_sources, count(DISTINCT serp_source) AS n_sources
        FROM @payload_rows WHERE url <> '' AND (serp_source <> 'organic_results' OR domain IN {_SUPPORTED}) GROUP BY 1, 2""",
)
def search_results(spark, d):
    out = search.read_search_results(payloads(spark, d))
    return out.select(
        "analysis_id", "url", "title", "serp_source", "serp_price", "serp_currency",
        (F.size("serp_sources") > 0).alias("has_sources"), F.size("serp_sources").cast("long").alias("n_sources"),
    )


@query(
    "search_results_legacy",
    """SELECT analysis_id, section_rank, pos, url, title, price_original AS price,
        CASE WHEN contains(lower(title), 'sold') OR contains(lower(url), 'sold') THEN 'продан' ELSE 'неизвестно' END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, url ORDER BY (serp_source = 'shopping_results'), section_rank, pos) AS rn
              FROM @payload_rows WHERE serp_source <> 'exact_matches' AND url <> '')
        WHERE serp_source <> 'organic_results' OR rn = 1""",
)
def search_results_legacy(spark, d):
    out = search.read_search_results(payloads(spark, d), legacy=True)
    return out.select("analysis_id", "section_rank", "pos", "url", "title", F.col("serp_price").alias("price"), "status")


_STATS = f"""SELECT analysis_id, count(*) FILTER (serp_source = 'exact_matches') AS exact_matches,
    count(*) FILTER (serp_source = 'visual_matches') AS visual_matches,
    count(*) FILTER (serp_source = 'organic_results') AS organic_results,
    count(*) FILTER (serp_source = 'shopping_results') AS shopping_results, count(*) AS total,
    count(DISTINCT url) FILTER (url <> '' AND domain IN {_SUPPORTED}) AS supported_links FROM @link_rows GROUP BY 1"""


@query("payload_stats", _STATS)
def payload_stats(spark, d):
    return search.payload_stats(fixture(spark, d, "link_rows"))


@query(
    "needs_more_results",
    """SELECT analysis_id, NOT ((s >= 3 AND n >= 4) OR (v >= 2 AND s >= 2)) AS needs_more FROM (
        SELECT analysis_id, count(*) AS n, count(*) FILTER (serp_source = 'visual_matches') AS v,
          count(DISTINCT url) FILTER (url <> '' AND domain NOT IN ('example.com', 'shop-test.org')) AS s FROM (
            SELECT CAST(orderkey AS VARCHAR) AS analysis_id, serp_source, coalesce(url, '') AS url, domain FROM @listings) GROUP BY 1)""",
)
def needs_more_results(spark, d):
    rows = fixture(spark, d, "listings").withColumn("analysis_id", F.col("orderkey").cast("string"))
    stats = search.payload_stats(rows.withColumn("url", F.coalesce("url", F.lit(""))))
    return search.needs_more_results(stats, 3, 4, 2, 2).select("analysis_id", "needs_more")


@query(
    "merge_payloads",
    """SELECT analysis_id, section_rank, url, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY analysis_id, section_rank, CASE WHEN url = '' THEN '#' || pos ELSE url END ORDER BY src, pos) AS rn
        FROM (SELECT *, CASE WHEN suppkey % 2 = 0 THEN 0 ELSE 1 END AS src FROM (SELECT l.*, c.suppkey FROM @link_rows l JOIN @cands c USING (pos))))
        WHERE rn = 1""",
)
def merge_payloads(spark, d):
    rows = fixture(spark, d, "link_rows").join(fixture(spark, d, "cands").select("pos", "suppkey"), "pos")
    even = F.col("suppkey") % 2 == 0
    return search.merge_payloads(rows.filter(even), rows.filter(~even)).select("analysis_id", "section_rank", "url", "pos")


# --- merging, caps, ranking -------------------------------------------------------------


@query(
    "merge_by_link",
    """SELECT analysis_id, url, coalesce(arg_min(image, (section_rank, pos)) FILTER (image <> ''), '') AS image,
        coalesce(arg_min(title, (section_rank, pos)) FILTER (title <> ''), '') AS title,
        arg_min(serp_price, (section_rank, pos)) FILTER (serp_price IS NOT NULL) AS serp_price,
        arg_min(serp_currency, (section_rank, pos)) FILTER (serp_price IS NOT NULL) AS serp_currency,
        arg_min(serp_source, (section_rank, pos)) AS serp_source, min((section_rank, pos))[2] AS pos,
        (SELECT string_agg(s, ',' ORDER BY m) FROM (SELECT serp_source AS s, min((section_rank, pos)) AS m FROM @link_rows i
          WHERE i.analysis_id = o.analysis_id AND i.url = o.url GROUP BY 1)) AS sources
        FROM @link_rows o WHERE url <> '' GROUP BY analysis_id, url""",
)
def merge_by_link(spark, d):
    out = c.merge_by_link(fixture(spark, d, "link_rows"))
    return out.select(
        "analysis_id", "url", "image", "title", "serp_price", "serp_currency", "serp_source", "pos",
        F.array_join("serp_sources", ",").alias("sources"),
    )


cte("links", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, url ORDER BY {_ORD}) AS u1 FROM @cands WHERE url IS NOT NULL) WHERE u1 = 1")
cte("domain_ranked", f"SELECT *, row_number() OVER (PARTITION BY analysis_id, domain ORDER BY {_ORD}) AS dr FROM @links")


@query(
    "cap_per_domain",
    f"""SELECT pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY {_ORD}) AS rank
        FROM @domain_ranked WHERE dr <= 3) WHERE rank <= 20""",
)
def cap_per_domain(spark, d):
    return c.cap_per_domain(fixture(spark, d, "cands"), 3, 20).select("pos", F.col("rank").cast("long").alias("rank"))


@query(
    "domain_cap_rejected",
    """SELECT url, analysis_id, 'превышен лимит домена (' || domain || ', cap=6, bucket=similarity_tail)' AS reason
       FROM @domain_ranked WHERE dr > 6""",
)
def domain_cap_rejected(spark, d):
    return c.domain_cap_rejected(fixture(spark, d, "cands"), 6, "similarity_tail").select("url", "analysis_id", "reason")


cte(
    "first_bucket",
    f"""SELECT pos FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY {_ORD}) AS rank
        FROM @domain_ranked WHERE dr <= 3) WHERE rank <= 20""",
)
cte(
    "buckets",
    f"""SELECT pos, 1 AS bucket FROM @first_bucket UNION ALL
        SELECT pos, 2 FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, domain ORDER BY {_ORD}) AS r2 FROM @links
          WHERE pos NOT IN (SELECT pos FROM @first_bucket)) WHERE r2 <= 6""",
)


@query("two_buckets", "SELECT pos, bucket FROM @buckets")
def two_buckets(spark, d):
    return c.two_buckets(fixture(spark, d, "cands")).select("pos", "bucket")


def token_sql(d: str, p: str) -> str:
    rules = [
        ("= 'vestiairecollective.com'", "vestiaire", r"-([0-9]+)\.shtml$"),
        ("= 'popchill.com'", "popchill", "/product/([0-9]+)"),
        ("= 'poshmark.com'", "poshmark", "/listing/[^/?#]*-([0-9a-f]{24})(?:/|$)"),
        ("LIKE 'ebay.%'", "ebay", "/itm/([0-9]+)"),
        ("= 'rebag.com'", "rebag", "([0-9]{6,})/?$"),
        ("= 'therealreal.com'", "therealreal", "([^/]*)/*$"),
        ("= 'jolicloset.com'", "jolicloset", "--([0-9]+)(?:/|$)"),
    ]
    arms = " ".join(
        f"WHEN {d} {cond} AND regexp_extract(lower({p}), '{pat}', 1) <> '' THEN '{name}:' || regexp_extract(lower({p}), '{pat}', 1)"
        for cond, name, pat in rules
    )
    return f"CASE {arms} ELSE '' END"


def canonical_sql(src: str) -> str:
    """Canonical key of src(url, domain, ...) for urls without encoded characters."""
    clean = "CASE WHEN sq = '/' OR sq = '' THEN '/' ELSE regexp_replace(sq, '/$', '') END"
    loc = f"""CASE WHEN domain IN ('popchill.com', 'theluxurycloset.com', 'vestiairecollective.com')
        THEN regexp_replace({clean}, '^/[a-z]{{2}}(-[a-z]{{2}})?/', '/', 'i') ELSE {clean} END"""
    keep = """list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]*=.')),
        lambda x: lower(split_part(x, '=', 1)) || '=' || substr(x, position('=' IN x) + 1)),
        lambda x: NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src')))"""
    return f"""SELECT * EXCLUDE (sq, q, loc, tok, qs), CASE WHEN url IS NULL THEN '#' || pos WHEN tok <> '' THEN domain || '|' || tok
        ELSE 'https://' || domain || loc || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END END AS ckey
        FROM (SELECT *, {token_sql('domain', 'loc')} AS tok FROM (SELECT *, {loc} AS loc, {keep} AS qs FROM (
        SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS sq,
               regexp_extract(url, '[?]([^#]*)', 1) AS q FROM {src})))"""


cte("keyed", canonical_sql("@cands"))


@query(
    "dedupe_canonical",
    f"""SELECT pos, CASE WHEN url IS NULL THEN NULL ELSE ckey END AS canonical_key FROM (
        SELECT *, row_number() OVER (PARTITION BY analysis_id, ckey ORDER BY {_ORD}) AS rn FROM @keyed) WHERE rn = 1""",
)
def dedupe_canonical(spark, d):
    out = c.dedupe_canonical(fixture(spark, d, "cands"))
    return out.select("pos", F.when(F.col("url").isNotNull(), F.col("canonical_key")).alias("canonical_key"))


@query(
    "dedupe_dropped",
    "SELECT analysis_id, count(*) - count(DISTINCT ckey) AS dropped FROM @keyed GROUP BY 1",
)
def dedupe_dropped(spark, d):
    cands = fixture(spark, d, "cands")
    n = lambda df, name: df.groupBy("analysis_id").agg(F.count(F.lit(1)).alias(name))
    joined = n(cands, "n").join(n(c.dedupe_canonical(cands), "m"), "analysis_id")
    return joined.select("analysis_id", (F.col("n") - F.col("m")).alias("dropped"))


@query("exact_first", f"""SELECT analysis_id, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id
    ORDER BY CASE WHEN serp_source = 'exact_matches' THEN 0 ELSE 1 END, {_ORD} NULLS FIRST) AS rank FROM @cands) WHERE rank <= 30""")
def exact_first(spark, d):
    cands = fixture(spark, d, "cands")
    return c.top_k(cands, ["analysis_id"], r.exact_first(cands), 30).select("analysis_id", "pos", F.col("rank").cast("long").alias("rank"))


_VISUAL = f"CASE WHEN serp_source = 'exact_matches' THEN 0 ELSE 1 END, -similarity, CASE WHEN starts_with(domain, 'ebay.') THEN 0 ELSE 1 END, {_ORD} NULLS FIRST"


@query(
    "visual_base",
    f"""SELECT pos, title_rank FROM (SELECT * EXCLUDE (title_rank), row_number() OVER (PARTITION BY analysis_id ORDER BY {_VISUAL}) AS title_rank FROM @cands)
        WHERE title_rank <= 30""",
)
def visual_base(spark, d):
    return c.visual_base(fixture(spark, d, "cands"))[0].select("pos", F.col("title_rank").cast("long").alias("title_rank"))


@query(
    "visual_overflow",
    f"SELECT pos FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY {_VISUAL}) AS r FROM @cands) WHERE r > 30",
)
def visual_overflow(spark, d):
    return c.visual_base(fixture(spark, d, "cands"))[1].select("pos")


@query(
    "candidate_rank",
    f"SELECT pos, row_number() OVER (PARTITION BY analysis_id ORDER BY selection_priority, title_rank, {_VISUAL}) AS rank FROM @cands",
)
def candidate_rank(spark, d):
    return c.candidate_rank(fixture(spark, d, "cands")).select("pos", F.col("rank").cast("long").alias("rank"))


@query(
    "title_rank",
    "SELECT pos, row_number() OVER (PARTITION BY analysis_id ORDER BY partkey, pos) AS title_rank FROM @cands",
)
def title_rank(spark, d):
    cands = fixture(spark, d, "cands").drop("title_rank")
    out = c.title_rank(cands, F.col("partkey"), [F.col("partkey"), F.col("pos")])
    return out.select("pos", F.col("title_rank").cast("long").alias("title_rank"))


@query(
    "split_limit",
    f"SELECT analysis_id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY {_ORD} NULLS FIRST) AS r FROM @cands) WHERE r > 220",
)
def split_limit(spark, d):
    _, rest = c.split_limit(fixture(spark, d, "cands"), 220, "title_ai_tail_ignored_limit", "limit")
    return rest.select("analysis_id", "url", "title")


def _kept_pool(spark, d):
    """Few kept candidates in some analyses, many in others; the rest is the pool."""
    cands = fixture(spark, d, "cands")
    number = F.substring("analysis_id", 7, 3).cast("int")
    is_kept = F.col("partkey") % (20 + number * 25) == 3
    return cands.filter(is_kept), cands.filter(~is_kept)


cte(
    "range_rows",
    f"""SELECT *, CASE WHEN partkey % (20 + CAST(substr(analysis_id, 7) AS INT) * 25) = 3 THEN 0 ELSE 1 END AS src FROM @keyed""",
)
cte(
    "range_ranked",
    f"""SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY src, o1, o2, o3, o4, o5, {_ORD} NULLS FIRST) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY analysis_id, ckey ORDER BY src, o1, o2, o3, o4, o5, {_ORD} NULLS FIRST) AS k1 FROM (
        SELECT *, CASE WHEN src = 0 THEN selection_priority ELSE CASE WHEN serp_source = 'exact_matches' THEN 0 ELSE 1 END END AS o1,
          CASE WHEN src = 0 THEN title_rank ELSE CASE WHEN starts_with(domain, 'ebay.') THEN 0 ELSE 1 END END AS o2,
          CASE WHEN src = 0 AND serp_source <> 'exact_matches' THEN 1 ELSE 0 END AS o3,
          CASE WHEN src = 0 THEN -similarity ELSE 0 END AS o4,
          CASE WHEN src = 0 AND NOT starts_with(domain, 'ebay.') THEN 1 ELSE 0 END AS o5
        FROM @range_rows WHERE src = 0 OR url IS NOT NULL)) WHERE k1 = 1""",
)


@query(
    "keep_range",
    "SELECT pos, rank, src = 1 AS backfilled FROM @range_ranked WHERE rank <= 15 AND (src = 0 OR rank <= 8)",
)
def keep_range(spark, d):
    out = c.keep_range(*_kept_pool(spark, d))
    return out.select("pos", F.col("rank").cast("long").alias("rank"), "backfilled")


@query("keep_range_rejected", "SELECT analysis_id, url FROM @range_ranked WHERE src = 0 AND rank > 15")
def keep_range_rejected(spark, d):
    kept = c.exclude_seen(_kept_pool(spark, d)[0], fixture(spark, d, "cands").filter(F.lit(False)))
    return c.keep_range_rejected(kept).select("analysis_id", "url")


@query(
    "exclude_seen_days",
    """SELECT pos FROM @cands c WHERE NOT EXISTS (SELECT 1 FROM @cands s WHERE s.section_rank IN (0, 1)
       AND s.analysis_id = c.analysis_id AND s.url = c.url)""",
)
def exclude_seen_days(spark, d):
    """Two parts of the seen rows, each with bitmaps of its own that are merged."""
    cands = fixture(spark, d, "cands")
    on = ["analysis_id", "url"]
    parts = [cands.filter(F.col("section_rank") == k) for k in (0, 1)]
    bitmaps = membership.merged_bitmaps(*[membership.key_bitmaps(p.dropna(subset=on), on, 20) for p in parts])
    return c.exclude_seen(cands, parts[0].unionByName(parts[1]), bitmaps=bitmaps, bits=20).select("pos")


@query(
    "exclude_seen",
    """SELECT pos FROM @cands c WHERE NOT EXISTS (SELECT 1 FROM @cands s WHERE s.section_rank = 0
       AND s.analysis_id = c.analysis_id AND s.url = c.url)""",
)
def exclude_seen(spark, d):
    cands = fixture(spark, d, "cands")
    return c.exclude_seen(cands, cands.filter(F.col("section_rank") == 0)).select("pos")


@query(
    "upsert_by_url",
    f"""SELECT pos, tax > 0.05 AS refined FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, url
        ORDER BY CASE WHEN tax > 0.05 THEN 0 ELSE 1 END, {_ORD}) AS rn FROM @cands WHERE url IS NOT NULL) WHERE rn = 1""",
)
def upsert_by_url(spark, d):
    cands = fixture(spark, d, "cands")
    fine = F.col("tax") > 0.05
    return c.upsert_by_url(cands.filter(~fine), cands.filter(fine)).select("pos", fine.alias("refined"))


_CRAWL = f"""CASE WHEN starts_with(domain, 'ebay.') OR domain IN {in_list(fixed.FAST_DOMAINS)} THEN 0 WHEN domain IN {in_list(fixed.SLOW_DOMAINS)} THEN 2 ELSE 1 END,
    CASE WHEN serp_source = 'exact_matches' THEN 0 ELSE 1 END, selection_priority, title_rank, -similarity, {_ORD}"""


def batch_sql(src: str, limit: int) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY over_cap, ord) AS pick FROM (
        SELECT *, CASE WHEN dr <= CASE WHEN domain = 'therealreal.com' THEN 2 WHEN domain = 'ebay.com' THEN 1 ELSE 3 END THEN 0 ELSE 1 END AS over_cap FROM (
        SELECT *, row_number() OVER (PARTITION BY analysis_id, domain ORDER BY ord) AS dr FROM (
        SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY {_CRAWL}) AS ord FROM {src})))
        QUALIFY pick <= {limit}"""


@query("next_crawl_batch", f"SELECT pos, pick FROM ({batch_sql('@links', 20)})")
def next_crawl_batch(spark, d):
    return c.next_crawl_batch(fixture(spark, d, "cands")).select("pos", F.col("pick").cast("long").alias("pick"))


cte("crawled", f"SELECT * FROM ({batch_sql('@links', 20)})")
cte(
    "crawl_state",
    """SELECT analysis_id, count(*) FILTER (tax > 0.06) AS n_items, count(*) FILTER (tax > 0.07) AS n_priced FROM @crawled GROUP BY 1""",
)


def _crawl_state(spark, d):
    cands = fixture(spark, d, "cands")
    crawled = c.next_crawl_batch(cands).withColumn("needs_refine", F.col("discount") > 0.05)
    results = crawled.filter(F.col("tax") > 0.06).select(
        "analysis_id", "url", F.when(F.col("tax") > 0.07, F.lit(100.0)).alias("price")
    )
    return cands, crawled, results


def _follow_sql(limit: int, items: int) -> str:
    src = f"""(SELECT l.* FROM @links l LEFT JOIN @crawl_state s USING (analysis_id) WHERE coalesce(n_items, 0) < {items}
        AND (analysis_id, url) NOT IN (SELECT analysis_id, url FROM @crawled))"""
    return f"SELECT pos, pick FROM ({batch_sql(src, limit)})"


@query("follow_up_recovery", _follow_sql(8, 8))
def follow_up_recovery(spark, d):
    return c.follow_up_batch(*_crawl_state(spark, d), "recovery").select("pos", F.col("pick").cast("long").alias("pick"))


@query(
    "follow_up_refine",
    f"""SELECT pos, pick FROM (SELECT pos, row_number() OVER (PARTITION BY analysis_id ORDER BY {_ORD}) AS pick
        FROM @crawled WHERE discount > 0.05) WHERE pick <= 2""",
)
def follow_up_refine(spark, d):
    return c.follow_up_batch(*_crawl_state(spark, d), "refine").select("pos", F.col("pick").cast("long").alias("pick"))


@query(
    "follow_up_overflow",
    f"""SELECT pos, pick FROM (SELECT pos, row_number() OVER (PARTITION BY analysis_id ORDER BY {_ORD}) AS pick FROM @cands l
        LEFT JOIN @crawl_state s USING (analysis_id) WHERE url IS NOT NULL AND coalesce(n_items, 0) < 5
        AND (analysis_id, url) NOT IN (SELECT analysis_id, url FROM @crawled)) WHERE pick <= 3""",
)
def follow_up_overflow(spark, d):
    return c.follow_up_batch(*_crawl_state(spark, d), "overflow").select("pos", F.col("pick").cast("long").alias("pick"))


@query("follow_up_backfill", _follow_sql(6, 8))
def follow_up_backfill(spark, d):
    return c.follow_up_batch(*_crawl_state(spark, d), "backfill").select("pos", F.col("pick").cast("long").alias("pick"))


def _links_sql(rows: str) -> str:
    """First row per link of ``rows``."""
    return f"(SELECT * FROM {rows} WHERE url IS NOT NULL AND url <> '' QUALIFY row_number() OVER (PARTITION BY analysis_id, url ORDER BY {_ORD}) = 1)"


@query(
    "first_crawl_batch",
    f"""SELECT pos, pick FROM ({batch_sql(_links_sql("(SELECT * FROM @cands WHERE serp_source = 'exact_matches')"), 12)})
        UNION ALL SELECT pos, pick FROM ({batch_sql(_links_sql("(SELECT * FROM @cands WHERE analysis_id NOT IN (SELECT analysis_id FROM @cands WHERE serp_source = 'exact_matches'))"), 20)})""",
)
def first_crawl_batch(spark, d):
    return c.first_crawl_batch(fixture(spark, d, "cands")).select("pos", F.col("pick").cast("long").alias("pick"))


_PHASE2 = """(SELECT l.* FROM @cands l LEFT JOIN @crawl_state s USING (analysis_id)
    WHERE serp_source <> 'exact_matches' AND (coalesce(n_items, 0) < 8 OR coalesce(n_priced, 0) < 8)
      AND analysis_id IN (SELECT analysis_id FROM @cands WHERE serp_source = 'exact_matches')
      AND (analysis_id, url) NOT IN (SELECT analysis_id, url FROM @crawled))"""


@query(
    "follow_up_phase2",
    f"""WITH room AS (SELECT analysis_id, least(count(*), 20) - (SELECT count(DISTINCT url) FROM @crawled d WHERE d.analysis_id = c.analysis_id) AS free FROM @cands c GROUP BY 1)
        SELECT pos, pick, 'phase2' AS crawl_pass FROM ({batch_sql(_links_sql(_PHASE2), 8)}) JOIN room USING (analysis_id)
        WHERE pick <= CASE WHEN free > 0 THEN least(free, 8) ELSE 8 END""",
)
def follow_up_phase2(spark, d):
    out = c.follow_up_batch(*_crawl_state(spark, d), "phase2")
    return out.select("pos", F.col("pick").cast("long").alias("pick"), "crawl_pass")


@query(
    "rejection_log",
    """SELECT reason_code, count(*) AS n FROM (
        SELECT reason_code FROM @routed WHERE reason_code IS NOT NULL
        UNION ALL SELECT 'domain_cap' FROM @domain_ranked WHERE dr > 6) GROUP BY 1""",
)
def rejection_log(spark, d):
    cands = fixture(spark, d, "cands")
    log = r.rejections(
        r.route_candidates(cands, r.infer_brand(cands))[1], c.domain_cap_rejected(cands, 6, "similarity_tail")
    )
    return log.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))
