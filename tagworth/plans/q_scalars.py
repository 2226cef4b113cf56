"""Queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import display, money, status, urls, words
from .fixtures import fixture, load
from .q_candidates import canonical_sql, token_sql
from .registry import any_like, cte, in_list, mapping, query, rnd

# --- money ------------------------------------------------------------------------------

cte(
    "amounts",
    """SELECT *, CASE WHEN layout < 3 THEN CAST(whole || '.' || cents AS DOUBLE) END AS amount,
        CASE layout WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS cur FROM @price_texts""",
)


@query("parse_price", "SELECT text_id, amount AS price, cur AS currency FROM @amounts")
def parse_price(spark, d):
    return fixture(spark, d, "price_texts").select("text_id", money.parse_price("txt").alias("p")).select("text_id", "p.*")


@query(
    "parse_sold_price",
    "SELECT text_id, amount AS price, cur AS currency FROM @amounts",
)
def parse_sold_price(spark, d):
    rows = fixture(spark, d, "price_texts").withColumn("t", F.concat(F.lit("Sold at "), "txt"))
    return rows.select("text_id", money.parse_sold_price("t").alias("p")).select("text_id", "p.*")


@query(
    "parse_price_lenient",
    "SELECT text_id, amount AS price, cur AS currency FROM @amounts",
)
def parse_price_lenient(spark, d):
    return fixture(spark, d, "price_texts").select("text_id", money.parse_price_lenient("txt").alias("p")).select("text_id", "p.*")


@query(
    "is_valid_price_text",
    """SELECT text_id, CASE WHEN contains(txt, 'shipping') THEN FALSE WHEN amount IS NULL THEN TRUE
        ELSE amount >= 5 AND amount <= CASE cur WHEN 'USD' THEN 10000 WHEN 'EUR' THEN 9000 ELSE 8000 END END AS valid FROM @amounts""",
)
def is_valid_price_text(spark, d):
    return fixture(spark, d, "price_texts").select("text_id", money.is_valid_price_text("txt").alias("valid"))


@query(
    "currency_code",
    "SELECT currency_original AS raw, CASE currency_original WHEN '£' THEN 'GBP' WHEN 'jpy' THEN 'JPY' ELSE currency_original END AS code, count(*) AS n FROM @listings GROUP BY 1, 2",
)
def currency_code(spark, d):
    rows = fixture(spark, d, "listings").select(F.col("currency_original").alias("raw"))
    return rows.groupBy("raw", money.currency_code("raw").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "asking_price",
    f"""SELECT text_id, amount AS price, CASE WHEN amount IS NOT NULL THEN 'RUB' END AS currency, amount IS NULL AS failed,
        {rnd('amount / 91.4')} AS price_usd FROM (SELECT text_id, CASE WHEN layout < 3 THEN CAST(whole AS DOUBLE) END AS amount FROM @price_texts)""",
)
def asking_price(spark, d):
    from ..operators.lookups import to_usd

    texts = fixture(spark, d, "price_texts").withColumn(
        "t", F.when(F.col("layout") == 0, F.concat("whole", F.lit(" руб."))).when(F.col("layout") < 3, F.col("whole").cast("string")).otherwise(F.lit("ask me"))
    )
    asked = texts.select("text_id", money.asking_price("t", F.lit(None).cast("string")).alias("a")).select("text_id", "a.*")
    out = to_usd(asked, fixture(spark, d, "rates"), "price", "currency")
    return out.select("text_id", "price", "currency", F.col("error").isNotNull().alias("failed"), "price_usd")


@query(
    "money_text",
    """SELECT pos, CAST(CAST(trunc(price_original) AS BIGINT) AS VARCHAR) || ' ' || currency_original AS shown,
        CASE WHEN page_price IS NULL THEN 'N/A' ELSE CAST(CAST(trunc(page_price) AS BIGINT) AS VARCHAR) END AS page FROM @listings""",
)
def money_text(spark, d):
    return fixture(spark, d, "listings").select(
        "pos",
        display.money_text("price_original", "currency_original").alias("shown"),
        display.money_text("page_price", F.lit("")).alias("page"),
    )


@query(
    "percent_text",
    "SELECT pos, printf('%.1f%%', discount * 100) AS shown FROM @listings",
)
def percent_text(spark, d):
    return fixture(spark, d, "listings").select("pos", display.percent_text("discount").alias("shown"))


# --- urls -------------------------------------------------------------------------------

cte(
    "split_urls",
    """SELECT *, lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS host FROM @odd_urls""",
)
_DOMAIN = """CASE WHEN len(parts) >= 3 AND parts[-2] IN ('co', 'com', 'ne', 'or', 'ac') THEN array_to_string(parts[-3:], '.')
    WHEN len(parts) >= 2 THEN array_to_string(parts[-2:], '.') ELSE host END"""


@query("domain_of", f"SELECT page_id, {_DOMAIN} AS domain FROM (SELECT *, string_split(host, '.') AS parts FROM @split_urls)")
def domain_of(spark, d):
    return fixture(spark, d, "odd_urls").select("page_id", urls.domain_of("url").alias("domain"))


@query("is_ebay", "SELECT domain, starts_with(domain, 'ebay.') AS ebay, count(*) AS n FROM @listings GROUP BY 1, 2")
def is_ebay(spark, d):
    return fixture(spark, d, "listings").groupBy("domain", urls.is_ebay("domain").alias("ebay")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "safe_url",
    "SELECT page_id, CASE WHEN regexp_matches(url, '^(http|https|HTTP|HTTPS)://[^/?#]') THEN url END AS url FROM @odd_urls",
)
def safe_url(spark, d):
    return fixture(spark, d, "odd_urls").select("page_id", urls.safe_url("url").alias("url"))


@query(
    "mask_credentials",
    """SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN NULL WHEN contains(url, '@') THEN substr(url, position('@' IN url) + 1)
        WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN substr(url, position('//' IN url) + 2) ELSE url END AS masked FROM @odd_urls""",
)
def mask_credentials(spark, d):
    return fixture(spark, d, "odd_urls").select("page_id", urls.mask_credentials("url").alias("masked"))


@query(
    "truncate_url",
    "SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN NULL WHEN length(url) <= 30 THEN url ELSE left(url, 29) || '...' END AS url FROM @odd_urls",
)
def truncate_url(spark, d):
    return fixture(spark, d, "odd_urls").select("page_id", urls.truncate_url("url", 30).alias("url"))


cte("page_src", f"SELECT page_id AS pos, url, {_DOMAIN} AS domain FROM (SELECT *, string_split(host, '.') AS parts FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM {{pages}}))")


@query("canonical_key", f"SELECT pos AS page_id, ckey AS canonical_key FROM ({canonical_sql('@page_src')})")
def canonical_key(spark, d):
    return load(spark, d, "pages").select("page_id", urls.canonical_key("url").alias("canonical_key"))


cte("listing_paths", "SELECT pos, domain, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM @listings WHERE url IS NOT NULL")


@query("product_token", f"SELECT pos, {token_sql('domain', 'p')} AS token FROM @listing_paths")
def product_token(spark, d):
    rows = fixture(spark, d, "listings").filter(F.col("url").isNotNull())
    return rows.select("pos", urls.product_token("domain", urls.path_of("url")).alias("token"))


@query(
    "ebay_item_id",
    "SELECT pos, nullif(regexp_extract(url, '/itm/([0-9]+)', 1), '') AS item_id FROM @listing_paths",
)
def ebay_item_id(spark, d):
    rows = fixture(spark, d, "listings").filter(F.col("url").isNotNull())
    return rows.select("pos", urls.ebay_item_id("url").alias("item_id"))


@query("marketplace_of", "SELECT domain, 'EBAY_US' AS marketplace, count(*) AS n FROM @listings GROUP BY 1")
def marketplace_of(spark, d):
    rows = fixture(spark, d, "listings")
    return rows.groupBy("domain", urls.marketplace_of("domain").alias("marketplace")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "with_query_param",
    """SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || '_ul=US'
        || CASE WHEN contains(url, '#') THEN substr(url, position('#' IN url)) ELSE '' END AS url FROM {pages}""",
)
def with_query_param(spark, d):
    return load(spark, d, "pages").select("page_id", urls.with_query_param("url", "_ul", "US").alias("url"))


@query(
    "product_id_of",
    "SELECT pos, CASE WHEN linenumber = 2 THEN CAST(partkey AS VARCHAR) END AS product_id FROM @listings",
)
def product_id_of(spark, d):
    rows = fixture(spark, d, "listings").withColumn(
        "u", F.when(F.col("linenumber") == 2, F.concat(F.lit("https://a.com/x-p"), "partkey", F.lit("?q=-p9"))).otherwise(F.concat("url", F.lit("?z=-p5")))
    )
    return rows.select("pos", urls.product_id_of("u").alias("product_id"))


_LANG = in_list(fixed.LOCALE_LANGUAGES)


@query(
    "country_of_url",
    f"""SELECT pos, CASE WHEN url IS NULL THEN NULL WHEN domain = 'ebay.com' THEN 'US' WHEN linenumber = 3 THEN 'US'
        ELSE {mapping('domain', fixed.SITE_COUNTRY)} END AS country FROM @listings""",
)
def country_of_url(spark, d):
    return fixture(spark, d, "listings").select("pos", urls.country_of_url("url").alias("country"))


# --- status, condition, country ---------------------------------------------------------


@query("status_norm", "SELECT raw, st AS status FROM @status_of")
def status_norm(spark, d):
    rows = fixture(spark, d, "listings").select(F.col("status").alias("raw")).distinct()
    return rows.select("raw", status.status_norm("raw").alias("status"))


@query(
    "availability_norm",
    """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'Sold' WHEN 'O' THEN 'Available' END AS lenient,
        CASE o_orderstatus WHEN 'O' THEN 'Available' ELSE 'Sold' END AS strict FROM {orders}""",
)
def availability_norm(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", F.lit("https://schema.org/SoldOut")).when(
        F.col("o_orderstatus") == "O", F.lit("http://schema.org/InStock")
    ).otherwise(F.lit("PreOrder"))
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        status.availability_norm(raw).alias("lenient"),
        status.availability_norm(raw, strict=True).alias("strict"),
    )


def _by_no(values: list[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE CAST(text_id % 18 AS INT) {arms} END"


@query(
    "condition_norm",
    "SELECT text_id, "
    + _by_no(
        ["New", "Like new", "Used", "Very good", "New", "Used", None, "Pre-owned", "Excellent condition", "Good",
         "Shows wear", None, None, "Great condition", "Rank AB", "Sealed box; never opened", "a.b", "Pre-loved"]
    )
    + " AS condition FROM @condition_texts",
)
def condition_norm(spark, d):
    return fixture(spark, d, "condition_texts").select("text_id", status.condition_norm("txt").alias("condition"))


@query(
    "condition_from_text",
    "SELECT text_id, "
    + _by_no(
        ["New", "Like new", None, "sehr guter Zustand", None, None, None, "Pre-owned", "Excellent", None, "Shows wear", None,
         None, "Great condition", None, None, None, "Pre-loved"]
    )
    + " AS condition FROM @condition_texts",
)
def condition_from_text(spark, d):
    return fixture(spark, d, "condition_texts").select("text_id", status.condition_from_text("txt").alias("condition"))


@query(
    "labeled_condition",
    "SELECT text_id, CASE WHEN text_id % 2 = 0 THEN 'Very good' ELSE 'Used' END AS condition FROM @condition_texts",
)
def labeled_condition(spark, d):
    shown = F.when(F.col("text_id") % 2 == 0, F.lit("Item Condition: very good | box")).otherwise(F.lit("Etat - gebraucht • 2"))
    return fixture(spark, d, "condition_texts").select("text_id", status.labeled_condition(shown).alias("condition"))


@query(
    "condition_from_title",
    """SELECT text_id, CASE WHEN regexp_matches(lower(txt), 'brand new|new with tags') THEN 'New'
        WHEN regexp_matches(lower(txt), 'pre-owned|preloved') THEN 'Used' END AS condition FROM @condition_texts""",
)
def condition_from_title(spark, d):
    return fixture(spark, d, "condition_texts").select("text_id", status.condition_from_title("txt").alias("condition"))


@query(
    "condition_rank",
    "SELECT text_id, " + mapping("CAST(text_id % 5 AS INT)", {0: "Mint", 1: "Excellent", 2: "Used", 3: "New"}) + " AS condition FROM @condition_texts",
)
def condition_rank(spark, d):
    letters = F.element_at(F.array(*[F.lit(x) for x in ("A", "a/b", "B C", "s", "Z")]), (F.col("text_id") % 5 + 1).cast("int"))
    return fixture(spark, d, "condition_texts").select("text_id", status.condition_rank(letters).alias("condition"))


@query(
    "looks_like_condition",
    f"""SELECT text_id, coalesce(NOT {any_like('lower(txt)', fixed.CONDITION_BAD_MARKERS)} AND {any_like('lower(txt)', fixed.CONDITION_GOOD_MARKERS)}, FALSE) AS likely FROM @condition_texts""",
)
def looks_like_condition(spark, d):
    return fixture(spark, d, "condition_texts").select("text_id", status.looks_like_condition("txt").alias("likely"))


@query(
    "condition_or_default",
    f"""SELECT text_id, CASE WHEN coalesce(trim(txt), '') = '' THEN '{fixed.DEFAULT_CONDITION}' ELSE txt END AS condition,
        coalesce(txt, '') = '' OR (NOT regexp_matches(txt, '[^\\x00-\\x7F]') AND len(list_filter(regexp_extract_all(lower(txt), '[a-z'']+'),
          lambda w: w NOT IN {in_list(fixed.ENGLISH_CONDITION_WORDS)})) = 0) AS english FROM @condition_texts""",
)
def condition_or_default(spark, d):
    return fixture(spark, d, "condition_texts").select(
        "text_id", status.condition_or_default("txt").alias("condition"), status.looks_english("txt").alias("english")
    )


@query(
    "country_norm",
    "SELECT text_id, "
    + mapping(
        "CAST(text_id % 12 AS INT)",
        {0: "US", 1: "UK", 2: "US", 3: "Germany", 4: "GB", 5: "Paris", 6: "Curaçao", 7: "US", 8: "New Zealand", 11: "DE"},
    )
    + " AS country FROM @country_texts",
)
def country_norm(spark, d):
    return fixture(spark, d, "country_texts").select("text_id", status.country_norm("txt").alias("country"))


@query(
    "ended",
    "SELECT o_orderkey AS id, CASE WHEN o_orderdate < TIMESTAMP '1998-06-01 00:00:00' THEN 'Sold' END AS status FROM {orders}",
)
def ended(spark, d):
    end = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    now = F.lit("1998-06-01T00:00:00Z").cast("timestamp")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.ended(end, now).alias("status"))


# --- words ------------------------------------------------------------------------------


@query(
    "brand_token",
    "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS token FROM {documents}",
)
def brand_token(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(words.brand_token("text")).alias("token"))


cte(
    "folded",
    """SELECT doc_id, text, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS tok FROM {documents}""",
)


@query("brand_token_ascii", "SELECT doc_id, md5(tok) AS token FROM @folded")
def brand_token_ascii(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(words.brand_token_ascii("text")).alias("token"))


_STOP = in_list(fixed.TITLE_STOP_WORDS)


@query(
    "title_tokens",
    f"SELECT doc_id, md5(array_to_string(list_filter(string_split(tok, ' '), lambda w: length(w) >= 3 AND w NOT IN {_STOP}), ' ')) AS tokens FROM @folded",
)
def title_tokens(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(F.array_join(words.title_tokens("text"), " ")).alias("tokens"))


@query(
    "has_brand",
    "SELECT doc_id, contains(tok, 'the') OR contains(CAST(doc_id AS VARCHAR), 'the') AS hit FROM @folded",
)
def has_brand(spark, d):
    return load(spark, d, "documents").select(
        "doc_id", words.has_brand("text", F.col("doc_id").cast("string"), F.lit("Thé")).alias("hit")
    )


@query(
    "name_keywords",
    f"""SELECT p_partkey, array_to_string(list_slice(list_concat([p_name || ' bag', p_name, split_part(p_name, ' ', 2) || ' bag'],
        list_filter(string_split(p_name, ' '), lambda w: length(w) >= 3 AND w NOT IN {_STOP})), 1, 4), '|') AS keywords FROM {{part}}""",
)
def name_keywords(spark, d):
    name = F.concat("p_name", F.lit(" bag"))
    return load(spark, d, "part").select("p_partkey", F.array_join(words.name_keywords(name, 4), "|").alias("keywords"))


@query(
    "keyword_list",
    f"""SELECT p_partkey, array_to_string(list_filter([p_name, CASE WHEN lower(p_type) <> p_name THEN lower(p_type) END],
        lambda w: w IS NOT NULL AND length(w) >= 3 AND w NOT IN {_STOP}), '|') AS keywords FROM {{part}}""",
)
def keyword_list(spark, d):
    raw = F.array("p_name", F.lit("ab"), F.upper("p_name"), "p_type", F.lit("New"))
    return load(spark, d, "part").select("p_partkey", F.array_join(words.keyword_list(raw, 5), "|").alias("keywords"))


@query(
    "clean_text",
    """SELECT doc_id, CASE WHEN length(t) > 240 THEN rtrim(left(t, 237)) || '...' ELSE t END AS shown
        FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00a0}\\x{202f}]+', ' ', 'g')) AS t FROM {documents})""",
)
def clean_text(spark, d):
    return load(spark, d, "documents").select("doc_id", words.clean_text("text").alias("shown"))


@query(
    "mojibake_score",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{fixed.MOJIBAKE_PATTERN}')) * 2 + len(regexp_extract_all(text, '[{fixed.MOJIBAKE_CHARS}]')) * 3
        + len(regexp_extract_all(text, '[РС][{fixed.MOJIBAKE_CHARS}]')) * 4 AS BIGINT) AS score FROM {{documents}}""",
)
def mojibake_score(spark, d):
    return load(spark, d, "documents").select("doc_id", words.mojibake_score("text").cast("long").alias("score"))


@query(
    "repair_mojibake",
    "SELECT doc_id, md5(CASE WHEN strlen(text) = length(text) THEN 'привет ' || text ELSE text END) AS repaired FROM {documents}",
)
def repair_mojibake(spark, d):
    """A word read in the wrong code page before every text that this page can hold."""
    plain = F.octet_length("text") == F.char_length("text")
    rows = load(spark, d, "documents").select("doc_id", F.when(plain, F.concat(F.lit("РїСЂРёРІРµС‚ "), "text")).otherwise(F.col("text")).alias("text"))
    return rows.select("doc_id", F.md5(words.repair_mojibake("text")).alias("repaired"))


@query(
    "strip_markers",
    "SELECT doc_id, md5(replace(replace(text, '→', ''), '✓', '')) AS shown FROM {documents}",
)
def strip_markers(spark, d):
    noisy = F.concat(F.lit("✓"), "text", F.lit("→"))
    return load(spark, d, "documents").select("doc_id", F.md5(words.strip_markers(noisy)).alias("shown"))


@query(
    "clean_title",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS ebay,
        CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE p_name END AS realreal, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_name END AS poshmark FROM {part}""",
)
def clean_title(spark, d):
    k = F.col("p_partkey") % 3
    return load(spark, d, "part").select(
        "p_partkey",
        words.clean_title(F.when(k == 0, F.lit("Shop by  category | eBay")).otherwise(F.concat("p_name", F.lit(" - eBay"))), "ebay").alias("ebay"),
        words.clean_title(F.when(k == 1, F.lit("Sign in for $25 site credit")).otherwise(F.concat("p_name", F.lit(" | The RealReal"))), "therealreal").alias("realreal"),
        words.clean_title(F.when(k == 2, F.lit("Home | Poshmark")).otherwise(F.concat(F.lit(" "), "p_name")), "poshmark").alias("poshmark"),
    )


# --- display ----------------------------------------------------------------------------


@query(
    "escape_html",
    "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS shown FROM {pages}",
)
def escape_html(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(display.escape_html("html")).alias("shown"))


@query(
    "status_badge",
    f"""SELECT pos, CASE WHEN page_price IS NULL THEN 'No price' WHEN coalesce({any_like("lower(status)", fixed.BADGE_SOLD)}, FALSE) THEN 'Sold' ELSE 'Available' END AS badge FROM @listings""",
)
def status_badge(spark, d):
    return fixture(spark, d, "listings").select("pos", display.status_badge("status", "page_price").alias("badge"))


@query("run_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS stamp FROM {events}")
def run_stamp(spark, d):
    return load(spark, d, "events").select("event_id", display.run_stamp("ts").alias("stamp"))


@query("content_hash", "SELECT page_id, sha256(html) AS hash FROM {pages}")
def content_hash(spark, d):
    return load(spark, d, "pages").select("page_id", display.content_hash(F.col("html").cast("binary")).alias("hash"))
