"""Input tables of the registered queries, derived from the given parquet tables.

The texts are plain SQL that Spark and an independent checking engine both read, so
that a check starts from the same rows.  Everything after them is built by operators.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FEATURE_RGB = [(1, 2, 3), (4, 5, 6), (7, 8, 9)]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_DOMAINS = [
    "ebay.com", "poshmark.com", "vestiairecollective.com", "rebag.com", "theluxurycloset.com",
    "fashionphile.com", "jolicloset.com", "yoogiscloset.com", "therealreal.com",
    "celebrityowned.com", "aretrotale.com", "dallasdesignerhandbags.com", "popchill.com",
    "designerexchange.com", "annsfabulousfinds.com", "example.com", "shop-test.org",
]
_BRANDS = [
    "Chanel", "Louis Vuitton", "YSL", "Gucci", "Hermès", "Christian Dior", "D&G", "LV",
    "Miu Miu", "Bottega-Veneta", "", "Unbranded",
]


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


_DOMAIN = _case("CAST(l.l_suppkey % 17 AS INT)", _DOMAINS)
_BRAND_NO = "CASE WHEN l.l_partkey % 4 <> 0 THEN CAST(substr(p.p_brand, 7) AS INT) % 8 ELSE CAST(l.l_partkey % 12 AS INT) END"
_SECTION = _case("l.l_linenumber % 4", ["exact_matches", "visual_matches", "organic_results", "shopping_results"])
_CURRENCY = _case("CAST(s.s_nationkey % 6 AS INT)", ["USD", "EUR", "£", "jpy", "RUB", "SEK"])
_STATUS = """CASE l.l_returnflag || l.l_linestatus
    WHEN 'AF' THEN 'Sold Out' WHEN 'AO' THEN 'in stock' WHEN 'NF' THEN 'unknown'
    WHEN 'RF' THEN 'SOLD yesterday' WHEN 'RO' THEN 'Available now' END"""
_URL = """CASE l.l_linenumber
    WHEN 1 THEN 'https://www.' || d.domain || '/itm/' || CAST(l.l_partkey AS STRING) || '?utm_source=x&ref=y'
    WHEN 2 THEN 'https://' || d.domain || '/products/' || replace(p.p_name, ' ', '-') || '-' || CAST(l.l_partkey AS STRING)
    WHEN 3 THEN 'http://us.' || d.domain || '/us-en/women-bags/handbags/chanel/bag-' || CAST(l.l_partkey AS STRING) || '.shtml'
    WHEN 4 THEN 'https://www.' || d.domain || '/shop/chanel'
    WHEN 5 THEN 'https://' || d.domain || '/listing/bag-' || lpad(CAST(l.l_partkey AS STRING), 24, '0') || '?b=2&a=1&gclid=z'
    WHEN 6 THEN 'https://' || d.domain || '//en/product/' || CAST(l.l_partkey AS STRING) || '/'
    ELSE CASE WHEN l.l_partkey % 5 = 0 THEN NULL ELSE 'https://' || d.domain || '/bags/a/b/bag--' || CAST(100000 + l.l_partkey AS STRING) END
    END"""

FIXTURES: dict[str, str] = {
    "listings": f"""
        SELECT p.p_brand AS analysis_id,
               CAST(l.l_linenumber % 4 AS INT) AS section_rank,
               {_SECTION} AS serp_source,
               (l.l_orderkey * 8 + l.l_linenumber) * 100000000 + l.l_partkey * 1000
                 + CAST(l.l_suppkey + floor(l.l_extendedprice) AS BIGINT) % 1000 AS pos,
               d.domain AS domain,
               {_URL} AS url,
               trim({_case(f"({_BRAND_NO})", _BRANDS)} || ' ' || p.p_brand || ' ' || p.p_name || ' ' || p.p_type) AS title,
               l.l_extendedprice AS price_original,
               {_CURRENCY} AS currency_original,
               {_STATUS} AS status,
               CASE l.l_linenumber % 3 WHEN 1 THEN l.l_extendedprice WHEN 2 THEN l.l_discount * 250 END AS page_price,
               CASE WHEN l.l_partkey % 3 = 0 THEN NULL WHEN l.l_partkey % 3 = 1 THEN l.l_quantity ELSE l.l_tax * 100 END AS serp_price,
               l.l_quantity AS quantity, l.l_discount AS discount, l.l_tax AS tax,
               l.l_partkey AS partkey, l.l_suppkey AS suppkey, l.l_orderkey AS orderkey, l.l_linenumber AS linenumber
        FROM {{lineitem}} l
        JOIN {{part}} p ON l.l_partkey = p.p_partkey
        JOIN (SELECT s_suppkey, s_nationkey FROM {{supplier}}) s ON l.l_suppkey = s.s_suppkey
        JOIN (SELECT s_suppkey AS k, {_case("CAST(s_suppkey % 17 AS INT)", _DOMAINS)} AS domain FROM {{supplier}}) d
          ON l.l_suppkey = d.k""",
    "cands": """
        SELECT analysis_id, section_rank, pos, serp_source, domain, url, title,
               0.8E0 + discount AS similarity, CAST(linenumber % 2 AS INT) AS selection_priority,
               CAST(partkey % 50 AS INT) AS title_rank, partkey, suppkey, quantity, discount, tax
        FROM {listings}""",
    "link_rows": """
        SELECT analysis_id, section_rank, pos, serp_source, domain, coalesce(url, '') AS url,
               CASE WHEN pos % 3 = 0 THEN '' ELSE title END AS title,
               CASE WHEN pos % 2 = 0 THEN '' ELSE 'https://img/' || CAST(partkey AS STRING) END AS image,
               CASE WHEN pos % 4 > 0 THEN serp_price END AS serp_price,
               CASE WHEN pos % 4 > 0 THEN currency_original END AS serp_currency
        FROM {listings}""",
    "rates": """
        SELECT code, rate FROM (VALUES ('USD', 1.0E0), ('EUR', 0.92E0), ('GBP', 0.79E0), ('JPY', 151.3E0), ('RUB', 91.4E0))
            AS t(code, rate)""",
    "rate_history": """
        SELECT CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'JPY' END AS code,
               0.5E0 + value / 100 AS rate, ts AS as_of
        FROM {events} WHERE event_type = 'purchase'""",
    "dated_prices": """
        SELECT event_id, ts, value AS price_original,
               CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'JPY' WHEN 3 THEN 'USD' ELSE 'SEK' END AS currency_original
        FROM {events} WHERE event_type <> 'purchase'""",
    "price_texts": """
        SELECT *, CASE layout
            WHEN 0 THEN '$' || thousands || CASE WHEN whole >= 1000 THEN ',' ELSE '' END || rest || '.' || cents
            WHEN 1 THEN thousands || CASE WHEN whole >= 1000 THEN '.' ELSE '' END || rest || ',' || cents || ' EUR'
            WHEN 2 THEN 'now ' || thousands || CASE WHEN whole >= 1000 THEN ' ' ELSE '' END || rest || '.' || cents || ' gbp'
            ELSE CASE WHEN whole % 3 = 0 THEN 'free shipping soon' ELSE 'ask me' END END AS txt
        FROM (SELECT text_id, layout, whole, lpad(CAST(cent AS STRING), 2, '0') AS cents,
                CASE WHEN whole >= 1000 THEN CAST(CAST((whole - whole % 1000) / 1000 AS BIGINT) AS STRING) ELSE '' END AS thousands,
                CASE WHEN whole >= 1000 THEN lpad(CAST(whole % 1000 AS STRING), 3, '0') ELSE CAST(whole AS STRING) END AS rest
              FROM (SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS text_id,
                      CAST(l_linenumber % 4 AS INT) AS layout, CAST(floor(l_extendedprice) AS BIGINT) AS whole,
                      CAST(round((l_extendedprice - floor(l_extendedprice)) * 100) AS BIGINT) AS cent FROM {lineitem}) a) b""",
    "condition_texts": """
        SELECT p_partkey AS text_id, p_name, CASE CAST(p_partkey % 18 AS INT)
            WHEN 0 THEN 'Brand New with tags' WHEN 1 THEN 'Like  new' WHEN 2 THEN 'https://schema.org/UsedCondition'
            WHEN 3 THEN 'sehr guter Zustand' WHEN 4 THEN 'как новое' WHEN 5 THEN 'б/у' WHEN 6 THEN 'More info >'
            WHEN 7 THEN 'Pre-Owned - excellent' WHEN 8 THEN 'Excellent condition. Light wear' WHEN 9 THEN 'gut'
            WHEN 10 THEN 'Shows wear' WHEN 11 THEN '' WHEN 12 THEN NULL WHEN 13 THEN 'Great Condition!'
            WHEN 14 THEN 'Rank AB' WHEN 15 THEN 'Sealed box; never opened' WHEN 16 THEN 'a.b' ELSE p_name || ' preloved' END AS txt
        FROM {part}""",
    "country_texts": """
        SELECT c_custkey AS text_id, CASE CAST(c_custkey % 12 AS INT)
            WHEN 0 THEN 'Miami, Florida, United States' WHEN 1 THEN 'uk' WHEN 2 THEN 'en_US' WHEN 3 THEN 'germany'
            WHEN 4 THEN 'GB' WHEN 5 THEN 'Paris, , ' WHEN 6 THEN 'Curaçao' WHEN 7 THEN 'U.S.A.' WHEN 8 THEN 'new ZEALAND'
            WHEN 9 THEN '' WHEN 10 THEN NULL ELSE 'Rostock,DE' END AS txt
        FROM {customer}""",
    "odd_urls": """
        SELECT page_id, CASE CAST(page_id % 10 AS INT)
            WHEN 0 THEN replace(url, '://', '://user:pw@') WHEN 1 THEN replace(replace(url, 'http://', ''), 'https://', '')
            WHEN 2 THEN replace(url, '.com/', '.com:8080/') WHEN 3 THEN url || '&x=a b|c' WHEN 4 THEN 'javascript:alert(1)'
            WHEN 5 THEN '/relative/path' WHEN 6 THEN upper(url) WHEN 7 THEN NULL WHEN 8 THEN '' ELSE url END AS url
        FROM {pages}""",
    "listing_pages": """
        SELECT p_partkey AS page_id, 'https://www.' || dom || '/products/x-p' || CAST(p_partkey AS STRING) AS url, kind, p_name, price, dom,
               '<html><head><title>' || p_name || ' shop</title>' || CASE kind
                 WHEN 0 THEN '<script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"s"},{"@type":"Product","name":"' || p_name || '","sku":"' || CAST(p_partkey AS STRING)
                   || '","offers":{"price":"' || price || '","priceCurrency":"EUR","availability":"https://schema.org/OutOfStock"}}]}</script>'
                 WHEN 1 THEN '<meta property="product:price:amount" content="' || price || '"><meta content="GBP" property="product:price:currency">'
                 WHEN 2 THEN '<script>var d = {"usdCents":"' || replace(price, '.', '') || '"};</script>' ELSE '' END
               || '</head><body><h1>' || p_name || '</h1>' || CASE WHEN kind = 3 THEN '<span class="price">$' || price || '</span>' ELSE '' END
               || '<table><tr><th>Condition</th><td>Very good</td></tr></table><dl><dt>Ships from</dt><dd>Rome, Italy</dd></dl><p>'
               || p_type || '</p></body></html>' AS html
        FROM (SELECT p_partkey, p_name, p_type, CAST(p_partkey % 4 AS INT) AS kind, 'example.com' AS dom,
                CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || '.' || lpad(CAST(p_partkey % 100 AS STRING), 2, '0') AS price FROM {part}) a""",
    "parsed": """
        SELECT pos, analysis_id, domain, url, title, page_price, CASE WHEN linenumber = 2 THEN 'EUR' END AS page_currency,
               serp_price, CASE WHEN partkey % 2 = 0 THEN 'GBP' END AS serp_currency,
               CASE WHEN partkey % 11 = 0 THEN 'blocked' WHEN partkey % 13 = 0 THEN 'catalog page' ELSE status END AS status,
               CASE WHEN partkey % 7 = 0 THEN '' WHEN partkey % 7 = 1 THEN NULL ELSE 'used' END AS condition, partkey, linenumber
        FROM {listings}""",
    "crawl_events": """
        SELECT event_id, ts, CAST(user_id % 12 AS INT) AS domain_no,
               'site' || CAST(user_id % 12 AS STRING) || '.com' AS domain,
               'proxy' || CAST(user_id % 5 AS STRING) AS proxy,
               CASE WHEN user_id % 5 < 3 THEN 'rotating' ELSE 'static' END AS proxy_type,
               event_type <> 'error' AS ok,
               CASE WHEN event_type = 'error' THEN
                 CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'Proxy blocked by target' WHEN 1 THEN 'HTTP 403 access denied'
                      WHEN 2 THEN 'Read timed out' ELSE '407 proxy authentication' END END AS error
        FROM {events}""",
    "log_events": """
        SELECT event_id, ts, event_type AS stage, value AS seconds, CAST(user_id AS STRING) AS trace,
               'crawl.' || event_type AS event, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
               'site' || CAST(user_id % 12 AS STRING) || '.com' AS domain
        FROM {events}""",
    "tasks": """
        SELECT CAST(o_custkey AS STRING) AS task_id, o_orderkey AS seq, o_orderdate AS ts,
               CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'queued'
                    ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'started' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'lost' END END AS raw_status
        FROM {orders}""",
    "doc_titles": """
        SELECT source AS analysis_id, doc_id AS pos, text AS title, lang,
               'https://example.com/' || CAST(doc_id AS STRING) AS url,
               CASE WHEN doc_id % 4 = 0 THEN 'exact_matches' ELSE 'visual_matches' END AS serp_source
        FROM {documents}""",
}


# Small tables whose rows take long work each; a file of few row groups would leave it to few tasks.
DEALT = {"listing_pages": {"part": "p_partkey"}}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input table as a Spark data frame."""
    text = FIXTURES[name]
    used = sorted(set(re.findall(r"\{([a-z]\w*)\}", text)))
    sources = {t: load(spark, sf_dir, t) if t in TABLES else fixture(spark, sf_dir, t) for t in used}
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for t, key in DEALT.get(name, {}).items():
        sources[t] = sources[t].repartition(tasks, key)
    # braces that are not placeholders are part of the text
    quoted = re.sub(r"[{}]", lambda m: m[0] * 2, re.sub(r"\{([a-z]\w*)\}", "\x02\\1\x03", text))
    return spark.sql(quoted.replace("\x02", "{").replace("\x03", "}"), **sources)
