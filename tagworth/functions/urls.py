"""URL functions.

URLs are cut with regular expressions, not ``parse_url``: the strict parser returns
null for urls with a space or a pipe, which do occur in search results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .base import ColumnOrName, blank_to_null, first_hit, let, lookup, text

_SCHEME = "(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?"


def host_of(url: ColumnOrName) -> Column:
    """Authority part in lower case, port included; empty when there is none."""
    return F.lower(F.regexp_extract(text(url), f"^\\s*{_SCHEME}//([^/?#]*)", 1))


def path_of(url: ColumnOrName) -> Column:
    return F.regexp_extract(text(url), f"^\\s*{_SCHEME}(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: ColumnOrName) -> Column:
    return F.regexp_extract(text(url), "^[^?#]*\\?([^#]*)", 1)


def domain_of(url: ColumnOrName) -> Column:
    """Registered domain: last two labels, three below ``co``/``com``-like suffixes."""
    suffixes = "|".join(fixed.SECOND_LEVEL_SUFFIXES)
    tail = f"((?:[^.]*\\.(?:{suffixes})\\.[^.]*)|(?:[^.]*\\.[^.]*)|[^.]*)$"
    return F.regexp_extract(host_of(url), tail, 1)


def is_ebay(domain: ColumnOrName) -> Column:
    d = text(domain)
    return d.startswith("ebay.") | (d == "ebay")


def last_segment(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def depth_of(path: Column) -> Column:
    """Number of non-empty path segments."""
    return F.regexp_count(path, F.lit("[^/]+"))


class _Url:
    """Named parts of one url for the product-page rules."""

    def __init__(self, url: Column):
        self.whole = F.lower(url)
        self.path = F.regexp_replace(path_of(url), ";[^/]*$", "")
        self.low = F.lower(self.path)
        self.last = last_segment(self.low)
        self.before_last = F.regexp_extract(self.low, "([^/]+)/+[^/]+/*$", 1)
        self.depth = depth_of(self.low)
        self.slashes = F.length(self.path) - F.length(F.replace(self.path, F.lit("/"), F.lit("")))
        self.listing_word = self.last.isin(fixed.BRAND_SLUGS + fixed.CATEGORY_SLUGS)

    def has(self, *parts: str) -> Column:
        return F.greatest(*[self.whole.contains(p) for p in parts]) if len(parts) > 1 else self.whole.contains(parts[0])

    def starts(self, *parts: str) -> Column:
        out = self.path.startswith(parts[0])
        for p in parts[1:]:
            out = out | self.path.startswith(p)
        return out


def _product_rules(u: _Url) -> dict[str, tuple[list[tuple[Column, bool]], bool]]:
    """Per domain: ordered (condition, is product page) rules and the default."""
    shop_root = u.path.isin("/shop", "/shop/")
    return {
        "poshmark.com": (
            [
                (u.low.contains("/listing/") & u.last.isin(fixed.BLOCKED_LISTING_SLUGS), False),
                (u.low.contains("/listing/"), True),
                (u.has("/browse/", "/category/", "/brand/", "/search"), False),
            ],
            True,
        ),
        "vestiairecollective.com": (
            [
                (u.path.rlike("[/-][0-9]+\\.shtml$"), True),
                (u.listing_word, False),
                ((u.depth >= 2) & u.before_last.isin(fixed.BRAND_SLUGS), False),
                (u.path.endswith("/") & (u.depth <= 4), False),
                (u.depth <= 2, False),
            ],
            True,
        ),
        "rebag.com": ([(u.has("/curation/"), False), (shop_root, False)], True),
        "theluxurycloset.com": (
            [
                (
                    u.starts("/women/", "/men/", "/bags/", "/shoes/", "/accessories/", "/jewelry/", "/watches/")
                    & (u.slashes <= 2),
                    False,
                )
            ],
            True,
        ),
        "fashionphile.com": ([(u.has("/products/"), True)], False),
        "jolicloset.com": ([(u.last.rlike("--[0-9]{4,}$"), True)], False),
        "yoogiscloset.com": (
            [
                (u.has("/bags/", "/designers/", "/sale/") & (u.slashes <= 3), False),
                (u.path.rlike("/[0-9]+") | (u.slashes > 2), True),
            ],
            False,
        ),
        "therealreal.com": (
            [
                (
                    u.has("/designers/", "/categories/", "/women/handbags", "/men/", "/jewelry/", "/watches/"),
                    None,
                ),
                (u.listing_word, False),
                (u.has("/products/") & (u.depth >= 4), True),
            ],
            False,
        ),
        "celebrityowned.com": ([(shop_root | u.has("/collections/"), False), (u.slashes > 1, True)], False),
        "aretrotale.com": (
            [(u.starts("/en-row/", "/en/") & (u.slashes <= 3), False), (u.has("/collections/"), False)],
            True,
        ),
        "dallasdesignerhandbags.com": (
            [(u.has("/collections/") & (u.slashes <= 3), False), (u.slashes > 1, True)],
            False,
        ),
        "popchill.com": (
            [(u.starts("/zh-TW", "/en") & (u.slashes <= 2), False), (u.has("/collections/"), False)],
            True,
        ),
        "designerexchange.com": (
            [(u.starts("/uk/", "/us/") & (u.slashes <= 3), False), (u.has("/collections/"), False)],
            True,
        ),
        "annsfabulousfinds.com": (
            [(u.has("/collections/") & (u.slashes <= 3), False), (u.slashes > 1, True)],
            False,
        ),
    }


def is_product_page(url: ColumnOrName) -> Column:
    """True for the page of one item, false for catalogs and empty urls."""

    def classify(parts: Column) -> Column:
        raw, domain = parts["url"], parts["domain"]
        u = _Url(raw)
        deep_product = u.has("/products/") & (u.depth >= 5)
        chain = F.when(raw == "", F.lit(False))
        ebay_rules = [
            (u.has("/itm/", "/p/"), True),
            (u.has("/b/", "/sch/", "/e/") | (u.low == "/shop") | u.low.startswith("/shop/"), False),
        ]
        chain = chain.when(is_ebay(domain), first_hit([(c, F.lit(v)) for c, v in ebay_rules], F.lit(True)))
        for name, (rules, default) in _product_rules(u).items():
            hits = [(c, deep_product if v is None else F.lit(v)) for c, v in rules]
            chain = chain.when(domain == name, first_hit(hits, F.lit(default)))
        return chain.otherwise(~u.listing_word & (u.depth > 1))

    raw = text(url)
    return let(F.struct(raw.alias("url"), domain_of(raw).alias("domain")), classify)


def catalog_reason(url: ColumnOrName) -> Column:
    """Why a page counts as a catalog page."""
    path = F.lower(F.regexp_replace(path_of(url), ";[^/]*$", ""))
    last, depth = last_segment(path), depth_of(path)
    return (
        F.when(last.isin(fixed.CATALOG_BRANDS), F.format_string(fixed.CATALOG_TEXT["brand"], last))
        .when(last.isin(fixed.CATALOG_CATEGORIES), F.format_string(fixed.CATALOG_TEXT["category"], last))
        .when(depth <= 2, F.format_string(fixed.CATALOG_TEXT["short"], depth))
        .otherwise(F.lit(fixed.CATALOG_TEXT["no_id"]))
    )


def likely_sold(url: ColumnOrName, title: ColumnOrName) -> Column:
    """Sold markers in the url or the title; false without a url."""
    u, t = F.lower(text(url)), F.lower(text(title))
    url_hit = F.lit(False)
    for marker in fixed.SOLD_URL_MARKERS:
        url_hit = url_hit | u.contains(marker)
    for marker in fixed.SOLD_TITLE_MARKERS:
        url_hit = url_hit | t.contains(marker)
    return (u != "") & url_hit


def product_token(domain: ColumnOrName, path: ColumnOrName) -> Column:
    """``site:id`` of a listing for the seven sites with a stable id, else empty."""
    d, p = text(domain), F.lower(text(path))

    def token(name: str, pattern: str) -> Column:
        found = F.regexp_extract(p, pattern, 1)
        return F.when(found != "", F.concat(F.lit(name + ":"), found))

    slug = F.regexp_extract(p, "([^/]*)/*$", 1)
    return F.coalesce(
        F.when(d.endswith("vestiairecollective.com"), token("vestiaire", "-([0-9]+)\\.shtml$")),
        F.when(d.endswith("popchill.com"), token("popchill", "/product/([0-9]+)")),
        F.when(d.endswith("poshmark.com"), token("poshmark", "/listing/[^/?#]*-([0-9a-f]{24})(?:/|$)")),
        F.when(d.startswith("ebay.") | d.endswith(".ebay.com"), token("ebay", "/itm/([0-9]+)")),
        F.when(d.endswith("rebag.com"), token("rebag", "([0-9]{6,})/?$")),
        F.when(d.endswith("therealreal.com") & (slug != ""), F.concat(F.lit("therealreal:"), slug)),
        F.when(d.endswith("jolicloset.com"), token("jolicloset", "--([0-9]+)(?:/|$)")),
        F.lit(""),
    )


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def clean_query(query: Column) -> Column:
    """Sorted query string without tracking keys and without empty values."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.")),
        lambda p: F.struct(
            F.lower(F.trim(_decode(F.substring_index(p, "=", 1)))).alias("k"),
            _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda kv: (kv["k"] != "") & ~kv["k"].startswith("utm_") & ~kv["k"].isin(fixed.TRACKING_KEYS),
    )
    joined = F.array_join(
        F.transform(F.array_sort(kept), lambda kv: F.concat(_encode(kv["k"]), F.lit("="), _encode(kv["v"]))), "&"
    )
    return F.when(query == "", F.lit("")).otherwise(joined)


def canonical_key(url: ColumnOrName) -> Column:
    """One key for all urls of the same listing."""
    raw = F.trim(text(url))

    def build(p: Column) -> Column:
        path = F.when(p["path"].contains("//"), F.regexp_replace(p["path"], "/+", "/")).otherwise(p["path"])
        path = F.when(path == "", F.lit("/")).when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
        has_locale = (
            p["domain"].endswith("popchill.com")
            | p["domain"].endswith("theluxurycloset.com")
            | p["domain"].endswith("vestiairecollective.com")
        )
        path = F.when(has_locale, F.regexp_replace(path, "(?i)^/[a-z]{2}(?:-[a-z]{2})?/", "/")).otherwise(path)

        def with_query(path: Column) -> Column:
            base = F.concat(F.lit("https://"), p["domain"], path)
            cleaned = let(clean_query(p["query"]), lambda q: F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q)))
            return F.when(p["query"] == "", base).otherwise(cleaned)

        def finish(q: Column) -> Column:  # the query is cleaned only where it is part of the key
            return F.when(q["token"] != "", F.concat_ws("|", p["domain"], q["token"])).otherwise(with_query(q["path"]))

        parts = F.struct(path.alias("path"), product_token(p["domain"], path).alias("token"))
        return F.when(p["host"] == "", p["raw"]).otherwise(let(parts, finish))

    return let(
        F.struct(
            raw.alias("raw"),
            host_of(raw).alias("host"),
            domain_of(raw).alias("domain"),
            path_of(raw).alias("path"),
            query_of(raw).alias("query"),
        ),
        build,
    )


def ebay_item_id(url: ColumnOrName) -> Column:
    u = text(url)
    in_path = F.regexp_extract(u, "(?i)/itm/(?:[^/?#]+/)?([0-9]+)(?:[/?#]|$)", 1)
    in_query = F.regexp_extract(u, "(?i)[?&]item=([0-9]+)(?:[&#]|$)", 1)
    return F.coalesce(blank_to_null(in_path), blank_to_null(in_query))


def marketplace_of(domain: ColumnOrName) -> Column:
    d = F.lower(F.trim(text(domain)))
    return F.coalesce(lookup(d, fixed.EBAY_MARKETPLACE), F.lit("EBAY_US"))


def with_query_param(url: ColumnOrName, key: str, value: str) -> Column:
    """Add ``key=value`` unless the query has the key already."""
    u = text(url)
    body = F.substring_index(u, "#", 1)
    tail = F.regexp_extract(u, "(#.*)$", 1)
    present = query_of(u).rlike(f"(?:^|&){key}(?:=|&|$)")
    joint = F.when(body.endswith("?") | body.endswith("&"), F.lit("")).when(body.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when(present, u).otherwise(F.concat(body, joint, F.lit(f"{key}={value}"), tail))


def product_id_of(url: ColumnOrName) -> Column:
    """Digits of ``-p123`` in the path; query strings are ignored."""
    return blank_to_null(F.regexp_extract(path_of(url), "-p([0-9]+)\\b", 1))


def country_of_url(url: ColumnOrName) -> Column:
    """Country by regional domain, two-letter sub-domain, path locale, then known site."""
    host = F.substring_index(host_of(url), ":", 1)
    domain = domain_of(url)
    first = F.substring_index(host, ".", 1)

    def code(c: Column) -> Column:
        return F.upper(c)

    path = F.lower(path_of(url))
    a = F.regexp_extract(path, "/([a-z]{2})[-_]([a-z]{2})/", 1)
    b = F.regexp_extract(path, "/([a-z]{2})[-_]([a-z]{2})/", 2)
    a_lang, b_lang = a.isin(fixed.LOCALE_LANGUAGES), b.isin(fixed.LOCALE_LANGUAGES)
    return F.when(
        host != "",
        F.coalesce(
            lookup(domain, fixed.EBAY_COUNTRY),
            F.when(first.rlike("^[a-z]{2}$") & ~first.isin("ww", "ws"), code(first)),
            F.when((a != "") & a_lang & ~b_lang, code(b)),
            F.when((a != "") & b_lang & ~a_lang, code(a)),
            lookup(domain, fixed.SITE_COUNTRY),
        ),
    )


def safe_url(url: ColumnOrName) -> Column:
    """http and https links with a host; anything else is null."""
    u = F.trim(text(url))
    return F.when(u.rlike("^(?i:https?)://[^/?#]"), u)


def mask_credentials(proxy_url: ColumnOrName) -> Column:
    """Host and port of a proxy url without scheme and credentials."""
    u = F.trim(text(proxy_url))
    return (
        F.when(u == "", F.lit(None).cast("string"))
        .when(u.contains("@"), F.regexp_extract(u, "^[^@]*@(.*)$", 1))
        .when(u.startswith("http://") | u.startswith("https://"), F.regexp_extract(u, "^[^/]*//(.*)$", 1))
        .otherwise(u)
    )


def truncate_url(url: ColumnOrName, limit: int = 140) -> Column:
    u = F.trim(text(url))
    return (
        F.when(u == "", F.lit(None).cast("string"))
        .when(F.length(u) <= limit, u)
        .otherwise(F.concat(F.substring(u, 1, limit - 1), F.lit("...")))
    )
