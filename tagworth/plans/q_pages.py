"""Queries: page text, diagnosis and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import html as h
from ..functions import objects as o
from ..operators import extract as e
from ..operators.site_rules import SCORED_SCRIPTS
from .fixtures import _DOMAINS, fixture, load
from .registry import cte, query

_STRIP = "html"
for _tag in ("script", "style", "noscript", "template"):
    _STRIP = f"regexp_replace({_STRIP}, '<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'gis')"
_STRIP = f"regexp_replace({_STRIP}, '<!--.*?-->', ' ', 'gs')"


def _text(expr: str) -> str:
    bare = f"regexp_replace({expr}, '<[^>]*>', ' ', 'g')"
    for k, v in (("&quot;", "\""), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = f"replace({bare}, '{k}', '{v}')"
    return f"trim(regexp_replace({bare}, '[\\s\\x{{00a0}}\\x{{202f}}]+', ' ', 'g'))"


@query("visible_text", f"SELECT page_id, md5(lower({_text(_STRIP)})) AS shown FROM {{pages}}")
def visible_text(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(h.visible_text("html")).alias("shown"))


@query(
    "page_headings",
    f"""SELECT page_id, {_text("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")} AS title,
        {_text("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is')")} AS h1, len(regexp_extract_all(html, '<a [^>]*href=')) AS n_links FROM {{pages}}""",
)
def page_headings(spark, d):
    return load(spark, d, "pages").select(
        "page_id", h.page_title("html").alias("title"), h.heading("html").alias("h1"), F.size(h.links("html")).cast("long").alias("n_links")
    )


@query(
    "page_lines",
    "SELECT page_id, len(list_filter(list_transform(string_split_regex(" + _STRIP + ", '<[^>]*>'), lambda t: trim(t)), lambda t: t <> '')) AS n FROM {pages}",
)
def page_lines(spark, d):
    return load(spark, d, "pages").select("page_id", F.size(h.text_lines("html")).cast("long").alias("n"))


@query(
    "diagnose_pages",
    """SELECT url, CASE code WHEN 407 THEN 'proxy_auth_required' WHEN 403 THEN 'blocked' WHEN 500 THEN 'error' ELSE
         CASE WHEN page_id % 5 = 4 THEN 'blocked' WHEN page_id % 5 = 3 THEN 'redirected' ELSE 'ok' END END AS status,
        CASE WHEN page_id % 5 = 4 THEN 'just a moment' END AS marker, length(html) + CASE WHEN page_id % 5 = 4 THEN 20 ELSE 0 END AS content_size
       FROM (SELECT *, CASE page_id % 5 WHEN 0 THEN 407 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END AS code FROM {pages})""",
)
def diagnose_pages(spark, d):
    k = F.col("page_id") % 5
    pages = load(spark, d, "pages").withColumns(
        {
            "status_code": F.when(k == 0, 407).when(k == 1, 403).when(k == 2, 500).otherwise(200),
            "final_url": F.when(k == 3, F.lit("https://other.com")).otherwise(F.col("url")),
            "html": F.when(k == 4, F.concat("html", F.lit("<p>Just a moment</p>"))).otherwise(F.col("html")),
        }
    )
    out = e.diagnose_pages(pages)
    return out.select(
        "url", "status", F.try_element_at("found_markers", F.lit("bot_challenge_text")).alias("marker"), F.col("content_size").cast("long").alias("content_size")
    )


@query(
    "has_price_signals",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN FALSE ELSE TRUE END AS signals FROM {pages}",
)
def has_price_signals(spark, d):
    k = F.col("page_id") % 3
    domain = F.when(k == 2, F.lit("ebay.com")).otherwise(F.lit("therealreal.com"))
    page = F.when(k == 1, F.concat("html", F.lit("<i data-testid='product-price/final'>"))).otherwise(F.col("html"))
    return load(spark, d, "pages").select("page_id", e.has_price_signals(domain, page).alias("signals"))


@query(
    "is_catalog_page",
    "SELECT page_id, page_id % 4 >= 2 AS catalog FROM {pages}",
)
def is_catalog_page(spark, d):
    k = (F.col("page_id") % 4 + 1).cast("int")
    page = F.concat("html", F.repeat(F.lit("<div class='product-card'></div>"), k))
    return load(spark, d, "pages").select("page_id", e.is_catalog_page(F.lit("vestiairecollective"), page).alias("catalog"))


@query(
    "meta_values",
    "SELECT page_id, CASE WHEN kind = 1 THEN price END AS amount, CASE WHEN kind = 1 THEN 'GBP' END AS currency FROM @listing_pages",
)
def meta_values(spark, d):
    m = fixture(spark, d, "listing_pages").withColumn("m", h.meta_values("html"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("page_id", get("product:price:amount").alias("amount"), get("product:price:currency").alias("currency"))


@query(
    "label_pairs",
    "SELECT page_id, 'Very good' AS condition, 'Rome, Italy' AS origin FROM @listing_pages",
)
def label_pairs(spark, d):
    rows = fixture(spark, d, "listing_pages").withColumn("p", h.label_pairs("html"))
    return rows.select(
        "page_id", h.label_value(F.col("p"), ["condition"]).alias("condition"), h.label_value(F.col("p"), ["ships from"]).alias("origin")
    )


@query(
    "jsonld_blocks",
    "SELECT page_id, CASE WHEN kind = 0 THEN p_name END AS name, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS blocks FROM @listing_pages",
)
def jsonld_blocks(spark, d):
    rows = fixture(spark, d, "listing_pages").withColumn("b", h.jsonld_blocks("html"))
    name = F.try_variant_get(F.get("b", F.lit(0)), "$['@graph'][1].name", "string")
    return rows.select("page_id", name.alias("name"), F.size("b").alias("blocks"))


def _objects(spark, d):
    return fixture(spark, d, "listing_pages").withColumns(
        {"ld": o.json_objects(h.jsonld_texts("html")), "scripts": h.scripts("html")}
    )


@query(
    "walk_objects",
    "SELECT page_id, CASE WHEN kind = 0 THEN 4 ELSE 0 END AS n, CASE WHEN kind = 0 THEN p_name END AS name FROM @listing_pages",
)
def walk_objects(spark, d):
    return _objects(spark, d).select("page_id", F.size("ld").alias("n"), o.name_from_objects(F.col("ld")).alias("name"))


@query(
    "price_from_jsonld",
    "SELECT page_id, CASE WHEN kind = 0 THEN CAST(price AS DOUBLE) END AS price, CASE WHEN kind = 0 THEN 'EUR' END AS currency FROM @listing_pages",
)
def price_from_jsonld(spark, d):
    out = _objects(spark, d).select("page_id", o.price_from_objects(F.col("ld")).alias("p"))
    return out.select("page_id", "p.*")


@query(
    "matched_price",
    """SELECT page_id, CASE WHEN kind = 0 AND page_id % 8 = 0 THEN CAST(price AS DOUBLE) END AS price,
       CASE WHEN kind = 0 AND page_id % 8 = 0 THEN 'Sold' END AS status FROM @listing_pages""",
)
def matched_price(spark, d):
    pid = F.when(F.col("page_id") % 8 == 0, F.col("page_id")).otherwise(F.col("page_id") + 1).cast("string")
    rows = _objects(spark, d)
    return rows.select(
        "page_id", o.matched_price(F.col("ld"), pid)["price"].alias("price"), o.matched_status(F.col("ld"), pid).alias("status")
    )


@query(
    "price_from_scripts",
    "SELECT page_id, CASE WHEN kind = 0 THEN CAST(price AS DOUBLE) END AS price, CASE WHEN kind = 0 THEN 'EUR' END AS currency FROM @listing_pages",
)
def price_from_scripts(spark, d):
    out = _objects(spark, d).select("page_id", e.price_from_scripts(F.col("scripts")).alias("p"))
    return out.select("page_id", "p.*")


@query(
    "scored_candidates",
    "SELECT page_id, CASE WHEN kind = 2 THEN CAST(price AS DOUBLE) WHEN kind = 0 THEN CAST(price AS DOUBLE) END AS price FROM @listing_pages",
)
def scored_candidates(spark, d):
    text = F.array_join("scripts", "\n")
    cands = e.scored_candidates(text, SCORED_SCRIPTS, F.lit(None).cast("string"))
    from ..operators.page_lines import scored_best

    return _objects(spark, d).select("page_id", scored_best(cands)["price"].alias("price"))


@query(
    "listing_generic",
    """SELECT page_id, p_name AS title, CASE kind WHEN 2 THEN NULL ELSE CAST(price AS DOUBLE) END AS price,
        CASE kind WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 3 THEN 'USD' END AS currency, CASE kind WHEN 0 THEN 'Sold' ELSE 'Available' END AS status FROM @listing_pages""",
)
def listing_generic(spark, d):
    out = e.listing_generic(e.page_fields(fixture(spark, d, "listing_pages").drop("price")))
    return out.select(
        "page_id", F.col("g_title").alias("title"), F.col("g_price").alias("price"), F.col("g_currency").alias("currency"), F.col("g_status").alias("status")
    )


@query("condition_country", "SELECT page_id, 'Very good' AS condition, 'Italy' AS country FROM @listing_pages")
def condition_country(spark, d):
    pages = fixture(spark, d, "listing_pages").withColumn("site", F.lit("other"))
    return e.condition_country(e.page_fields(pages)).select("page_id", "condition", "country")


@query(
    "site_hint",
    "SELECT page_id, 'https://x.com/p' || page_id || ' shop' AS hint FROM {pages}",
)
def site_hint(spark, d):
    head = F.concat(
        F.lit("<link rel='canonical' href='https://X.com/p"), "page_id", F.lit("'><meta property=\"og:site_name\" content=\"Shop\">"), "html"
    )
    return load(spark, d, "pages").select("page_id", h.site_hint(head).alias("hint"))


def _cut(expr: str, n: int) -> str:
    return f"CASE WHEN length({expr}) > {n} THEN rtrim(substr({expr}, 1, {n - 3})) || '...' ELSE {expr} END"


@query(
    "page_snapshot",
    f"""WITH t AS (
        SELECT page_id, {_text("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")} AS title,
               {_text("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is')")} AS h1, {_text(_STRIP)} AS shown FROM {{pages}}),
        c AS (SELECT page_id, '<title>' || title || '</title>' AS a, {_cut('h1', 220)} AS b, '<text>' || {_cut('shown', 1600)} || '</text>' AS c FROM t)
        SELECT page_id, a || chr(10) || CASE WHEN length(b) >= 4 THEN b || chr(10) ELSE '' END || c AS snapshot FROM c""",
)
def page_snapshot(spark, d):
    return e.page_snapshot(load(spark, d, "pages")).select("page_id", "snapshot")


# Status by kind of fixture page, for the sites in the order of _DOMAINS.  A stated
# availability counts first; otherwise a site either tells by its buy button, of which
# the fixture has none, or takes a page that says nothing as available or unknown.
_PAGE_STATUS = [
    "Sold Sold Sold Out Sold Out Out Sold Sold Out Out Out Out Out Out Sold Sold",
    "Unknown Unknown Sold Out Available Out Available Unknown Available Out Out Out Out Out Out Available Available",
    "Unknown Unknown Sold Out Available Out Out Unknown Available Out Out Out Out Out Out Available Available",
    "Unknown Unknown Sold Out Available Out Available Available Available Out Out Out Out Out Out Available Available",
]
_SITES = [fixed.SITE_BY_DOMAIN.get(x, x) for x in _DOMAINS]


def _page_status() -> str:
    lists = ", ".join("[" + ", ".join(f"'{'Sold Out' if w == 'Out' else w}'" for w in row.split()) + "]" for row in _PAGE_STATUS)
    return f"[{lists}][kind + 1][i + 1]"


@query(
    "extract_listings",
    f"""SELECT page_id, 'https://www.' || domain || '/products/x-p' || CAST(page_id AS VARCHAR) AS url, domain, site, p_name AS title,
        CASE WHEN priced THEN CAST(price AS DOUBLE) END AS price, CASE WHEN priced THEN CASE kind WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END END AS currency,
        {_page_status()} AS status, 'Very good' AS condition, 'Italy' AS country
        FROM (SELECT *, ['{"', '".join(_DOMAINS)}'][i + 1] AS domain, ['{"', '".join(_SITES)}'][i + 1] AS site,
            CASE WHEN domain_of[i + 1] IN ('fashionphile', 'dallasdesignerhandbags') THEN FALSE WHEN kind = 2 THEN domain_of[i + 1] = 'therealreal'
                 WHEN kind = 0 THEN domain_of[i + 1] <> 'yoogiscloset' ELSE TRUE END AS priced
            FROM (SELECT *, page_id % {len(_DOMAINS)} AS i, ['{"', '".join(x.split('.')[0] for x in _DOMAINS)}'] AS domain_of FROM @listing_pages) a) b""",
)
def extract_listings(spark, d):
    """Listing pages spread over all sites."""
    domain = F.element_at(F.array(*[F.lit(x) for x in _DOMAINS]), (F.col("page_id") % len(_DOMAINS) + 1).cast("int"))
    pages = fixture(spark, d, "listing_pages").select(
        "page_id", F.concat(F.lit("https://www."), domain, F.lit("/products/x-p"), "page_id").alias("url"), "html"
    )
    return e.extract_listings(pages)


@query(
    "extracted_record",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS title, CAST(p_size AS DOUBLE) AS price,
        CASE p_partkey % 2 WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'In stock' END AS status FROM {part}""",
)
def extracted_record(spark, d):
    part = load(spark, d, "part")
    k = F.col("p_partkey")
    record = F.struct(
        F.when(k % 3 == 0, F.lit("N/A")).otherwise(F.col("p_name")).alias("product_name"),
        F.when(k % 2 == 0, F.concat("p_size", F.lit(",00 €"))).otherwise(F.col("p_size").cast("string")).alias("price"),
        F.when(k % 5 == 0, F.lit("unknown")).otherwise(F.lit("In stock")).alias("availability"),
    )
    rows = part.select("p_partkey", F.to_json(record).alias("record"))
    return e.extracted_record(rows).drop("condition")
