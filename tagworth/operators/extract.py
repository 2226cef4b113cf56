"""Listings out of already fetched pages.

One pass per page: every field is an expression over the page's own html, so extraction
never shuffles, and html is dropped before anything is joined.  Only embedded JSON takes
one Arrow hop.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import html as h
from ..functions import objects as o
from ..functions.base import any_of, blank_to_null, first_contained, has_any, let, text
from ..functions.money import currency_code, highest_price, parse_price, parse_price_lenient, plausible_price, price_in_limits, valid_price
from ..functions.scan import scanner
from ..functions.status import (
    condition_from_text,
    condition_norm,
    condition_rank,
    country_norm,
    labeled_condition,
    listing_is_sold,
)
from ..functions.urls import domain_of, path_of, product_id_of
from ..functions.words import clean_text, clean_title
from .listings import override_blocked, redirect_mismatch, with_fallback_meta
from .lookups import with_site
from .page_lines import anchor_price, labeled_price, scored_best
from .site_rules import (
    CATALOG_RULES,
    DEFAULT_CURRENCY,
    DEFAULT_STATUS,
    PRODUCT_SIGNALS,
    PRODUCT_TAGS,
    PROMO_CONTEXT,
    RULES,
    SCORED_PAYLOAD,
    SCORED_SCRIPTS,
    SCRIPT_PRICE_KEYS,
    SOLD_VOIDS_PRICE,
    STRICT_AVAILABILITY,
    Rule,
)

# Sites that may show a product in spite of a block marker.
SOFT_SITES = ("theluxurycloset", "therealreal")



def _price(value: Column, currency: Column) -> Column:
    return F.when(value > 0, F.struct(value.alias("price"), currency.alias("currency")))


def _first(prices: Column) -> Column:
    return F.get(F.filter(prices, lambda p: p.isNotNull()), F.lit(0))


# --- diagnosis --------------------------------------------------------------------------


def diagnose_pages(df: DataFrame) -> DataFrame:
    """Block diagnosis of fetched pages.

    Reads ``url, final_url, status_code, html``; optional ``content_type, proxy_used,
    proxy_authenticate`` (a response header).
    """
    have = set(df.columns)
    opt = lambda c: text(c) if c in have else F.lit("")
    raw = F.lower(text("html"))
    page = F.col("_page")
    base = df.withColumn("_page", h.page("html")).withColumns(
        {"_raw": raw, "_shown": h.visible_text(scanned=page), "_title": F.lower(text(h.page_title(scanned=page)))}
    )
    both = F.concat_ws(" ", "_title", "_shown")
    hard = [(kind, first_contained(both, {w: w for w in words})) for kind, words in fixed.VISIBLE_BLOCK_MARKERS.items()]
    hard += [(kind, first_contained(F.col("_raw"), {w: w for w in words})) for kind, words in fixed.RAW_BLOCK_MARKERS.items()]
    challenge = F.when(
        has_any(F.col("_raw"), fixed.CHALLENGE_SCRIPT_MARKERS),
        first_contained(both, {w: w for w in fixed.CHALLENGE_TEXT_MARKERS}),
    )
    auth = F.when(F.col("status_code") == 407, F.lit("407 status")).when(
        opt("proxy_authenticate") != "", F.lit("proxy-authenticate header")
    )
    hard += [("cloudflare_challenge", challenge), ("proxy_auth", auth)]
    soft = [(kind, first_contained(F.col("_shown"), {w: w for w in words})) for kind, words in fixed.SOFT_BLOCK_MARKERS.items()]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in hard + soft])
    markers = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    hard_names = [k for k, _ in hard]
    status = (
        F.when(F.array_contains("_names", "proxy_auth"), F.lit("proxy_auth_required"))
        .when(F.col("status_code").isin(401, 403), F.lit("blocked"))
        .when(F.col("status_code") >= 400, F.lit("error"))
        .when(F.arrays_overlap("_names", F.array(*[F.lit(n) for n in hard_names])), F.lit("blocked"))
        .when(F.col("final_url") != F.col("url"), F.lit("redirected"))
        .otherwise(F.lit("ok"))
    )
    return (
        base.withColumn("found_markers", markers)
        .withColumn("_names", F.map_keys("found_markers"))
        .select(
            "url",
            domain_of("url").alias("domain"),
            "status_code",
            "final_url",
            (F.col("final_url") != F.col("url")).alias("redirected"),
            opt("content_type").alias("content_type"),
            F.length(text("html")).alias("content_size"),
            F.substring(text("html"), 1, 300).alias("content_preview"),
            "found_markers",
            status.alias("status"),
            opt("proxy_used").alias("proxy_used"),
        )
    )


def has_price_signals(domain: Column, html: Column) -> Column:
    """Whether the html of three sites shows a price at all; true for other sites."""
    stated = F.exists(h.meta_entries(html), lambda e: e["key"].isin("product:price:amount", "og:price:amount", "price"))
    offered = let(html, lambda x: F.substring(x, F.instr(F.lower(x), '"@type":"offer"'), F.length(x)).contains('"price"') & F.lower(x).contains('"@type":"offer"'))
    signals = {
        "therealreal.com": html.rlike("(?i)data-testid=[\"'][^\"']*product-price/final|product-price-info__(?:final|reduced)-price"),
        "theluxurycloset.com": html.rlike("newProductPrice") | offered,
        "jolicloset.com": html.rlike("(?i)id=[\"']product[\"']|addcartbutton"),
    }
    out = None
    for site, shown in signals.items():
        hit = domain.endswith(site)
        out = F.when(hit, shown | stated) if out is None else out.when(hit, shown | stated)
    return out.otherwise(F.lit(True))


def is_catalog_page(site: Column, html: Column) -> Column:
    """Many product cards or product links instead of one product."""
    out = None
    for name, (card, cards, link, links) in CATALOG_RULES.items():
        many = (F.regexp_count(html, F.lit(card)) >= cards) | (F.regexp_count(html, F.lit(link)) >= links)
        out = F.when(site == name, many) if out is None else out.when(site == name, many)
    return out.otherwise(F.lit(False))


# --- prices -----------------------------------------------------------------------------


def price_from_scripts(scripts: Column, limit: float | None = None, context: int = 100) -> Column:
    """First price-like value in inline scripts, with a currency from the script.

    Values over ``limit``, or over what is plausible in their currency, are passed over.

    In a script the keys are tried in their order, wherever they stand; of the values of
    a key the first with a currency counts, else the last.  ``context`` characters on either
    side of a value may name the currency.
    """

    def of_script(s: Column) -> Column:
        def amount(m: Column) -> Column:
            value = F.replace(m["value"], F.lit(","), F.lit("")).try_cast("double")
            named = F.regexp_extract(s, "(?i)[\"']?(?:price)?currency[\"']?\\s*[:=]\\s*[\"']([A-Z]{3})[\"']", 1)
            near = parse_price(h.around(s, m, context, context))["currency"]
            found = F.struct(value.alias("v"), F.coalesce(blank_to_null(F.upper(named)), near).alias("c"))
            return let(found, lambda x: _price(F.when(x["v"] <= (highest_price(x["c"]) if limit is None else F.lit(limit)), x["v"]), x["c"]))

        def of_key(key: str) -> Column:
            pattern = f"(?i)[\"']?\\b{key}[\"']?\\s*[:=]\\s*[\"']?([0-9][0-9,]*(?:\\.[0-9]+)?)"
            return F.when(s.rlike(f"(?i)\\b{key}[\"']?\\s*[:=]"), h.match_spans(s, pattern, 1))

        def chosen(spans: Column) -> Column:
            found = F.filter(F.transform(spans, amount), lambda p: p.isNotNull())
            return let(found, lambda x: F.coalesce(F.get(F.filter(x, lambda p: p["currency"].isNotNull()), F.lit(0)), F.try_element_at(x, F.lit(-1))))

        return _first(F.transform(F.array(*[of_key(key) for key in SCRIPT_PRICE_KEYS]), chosen))

    return F.get(F.filter(F.transform(scripts, of_script), lambda p: p.isNotNull()), F.lit(0))


def price_universal(
    lines: Column, from_objects: Column, scripts: Column, html: Column, elements: Column | None = None, short_text: int = 30, short_element: int = 50
) -> Column:
    """Generic price: JSON-LD, scripts, short texts with a symbol, price elements, any short text.

    ``elements`` are texts of price elements, if they are known.  A text below ``short_text`` or an element or
    attribute below ``short_element`` characters can be a price.  What is plausible depends
    on the currency.
    """
    valid = lambda found: let(found, lambda p: F.when(plausible_price(p["price"], p["currency"]), p))
    short = F.filter(lines, lambda t: (F.length(t) < short_text) & t.rlike("[0-9]"))
    data = F.regexp_extract(html, f"(?i)\\sdata-(?:price|amount|value)\\s*=\\s*[\"']([^\"']{{1,{short_element - 1}}})[\"']", 1)
    elements = let(h.pick(html, "span.price", "div.price"), lambda m: F.array(F.try_element_at(m, F.lit("span.price")), F.try_element_at(m, F.lit("div.price")))) if elements is None else elements
    elements = F.concat(F.transform(elements, text), F.array(h.unescape(data)))
    texts = F.concat(
        F.filter(short, lambda t: t.rlike("[$€£¥₽]")), F.filter(elements, lambda t: F.length(t) < short_element), short
    )
    return F.coalesce(
        valid(from_objects), valid(price_from_scripts(scripts)), _first(F.transform(texts, valid_price))
    )


def scored_candidates(c: Column, rules: list[tuple[str, int, bool]], slug: Column, min_score: int = 16) -> Column:
    """Scored price candidates of a text as array of (score, pos, price, currency).

    A rule's base score grows with the page slug, price blocks and offer context; prices
    next to promotions are left out; cents become units.
    """
    low = F.lower(c)
    named = F.regexp_extract(c, "(?i)\"(?:priceCurrency|currencyCode|currency)\"\\s*:\\s*\"([A-Z]{3})\"", 1)
    page_bonus = (
        F.when((text(slug) != "") & low.contains(text(slug)), 20).otherwise(0)
        + F.when(has_any(low, ["product-price/final", "product-price-info__"]), 8).otherwise(0)
        + F.when(has_any(low, ["__next_data__", '"offers"']), 6).otherwise(0)
    )

    def candidate(m: Column) -> Column:
        near = F.lower(h.around(c, m["span"], 180, 180))
        amount = F.replace(m["span"]["value"], F.lit(","), F.lit("")).try_cast("double")
        final = F.when(near.rlike("final|reduced"), 4).otherwise(0)
        return F.struct(
            (m["base"] + page_bonus + final).alias("score"),
            m["span"]["pos"].alias("pos"),
            F.when(~has_any(near, PROMO_CONTEXT), amount / m["parts"]).alias("price"),
            F.coalesce(blank_to_null(F.upper(named)), F.lit("USD")).alias("currency"),
        )

    def spans(pattern: str, base: int, cents: bool) -> Column:
        parts = F.lit(100.0 if cents else 1.0)
        return F.transform(h.match_spans(c, pattern, 1), lambda m: F.struct(m.alias("span"), F.lit(base).alias("base"), parts.alias("parts")))

    every = F.transform(F.concat(*[spans(*r) for r in rules]), candidate)
    return F.filter(
        every, lambda x: (x["price"] > 0) & (x["price"] < fixed.MAX_REASONABLE_PRICE) & (x["score"] >= min_score)
    )


def nearby_price(script: Column, product_id: Column) -> Column:
    """Price within reach of the product id in script text."""
    behind = F.substring(F.split_part(script, F.concat(F.lit("-p"), product_id), F.lit(2)), 1, 1200)
    amount = F.regexp_extract(behind, "(?i)\"price\"\\s*:\\s*\"?([0-9][0-9,]*(?:\\.[0-9]+)?)", 1)
    value = F.replace(amount, F.lit(","), F.lit("")).try_cast("double")
    currency = F.regexp_extract(script, "(?i)\"priceCurrency\"\\s*:\\s*\"([A-Z]{3})\"", 1)
    return F.when(product_id.isNotNull() & (value >= 20), _price(value, F.coalesce(blank_to_null(F.upper(currency)), F.lit("USD"))))


# --- the job ----------------------------------------------------------------------------


# Selectors of the rules that hold for every page.
_PRICE_ELEMENTS = ["[itemprop=price]", "[data-test=price]", ".price", "#price", "span.amount", "div.amount"]
_COMMON = [*_PRICE_ELEMENTS, "span.price", "div.price", "[buyer-country=]@buyer-country"]


def _selectors(r: Rule) -> list[str]:
    if r.kind in ("has", "element", "lenient", "attr", "html_price", "described", "labeled"):
        return r.pattern.split(" || ")
    return []


def page_fields(pages: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Pages with their reusable parts, from one scan that looks for what their site needs."""
    by_site: dict[str, list[str]] = {site: list(PRODUCT_TAGS) for site in SOFT_SITES}
    for r in rules:
        by_site.setdefault(r.site, []).extend(_selectors(r))
    page = F.col("_page")
    site = F.col("site") if "site" in pages.columns else F.lit(None).cast("string")
    return pages.withColumn("_page", scanner(by_site, _COMMON)(text("html"), site)).withColumns(
        {
            "_entries": h.meta_entries(scanned=page),
            "_scripts": h.scripts(scanned=page),
            "_lines": h.text_lines(scanned=page),
            "_shown": h.shown_text(scanned=page),
            "_text": h.visible_text(scanned=page),
            "_allscripts": F.array_join(h.scripts(scanned=page), "\n"),
        }
    ).withColumns(
        {
            "_objects": o.json_objects(h.jsonld_texts(scanned=page)),
            "_state": o.json_objects(o.state_texts(F.col("_scripts"))),
            "_metacur": currency_code(
                h.meta_get(F.col("_entries"), "product:price:currency", "og:price:currency", "priceCurrency", "currency")
            ),
        }
    ).withColumn("_ldprice", o.price_from_objects(F.col("_objects")))


def _picked(selector: str) -> Column:
    """What the scan found for a selector, null when nothing fits."""
    return F.try_element_at(F.col("_page.picked"), F.lit(selector))


def _meta_candidate(keys: str) -> Column:
    """Meta content as text, with the currency the page states."""
    return _text_candidate(h.meta_get(F.col("_entries"), *keys.split(",")), F.col("_metacur"))


def _slug() -> Column:
    return F.lower(F.regexp_extract(path_of("url"), "([^/]+)/*$", 1))


def _candidate(shown: Column | None = None, price: Column | None = None, currency: Column | None = None, how: str = "plain") -> Column:
    none = F.lit(None)
    return F.struct(
        (none.cast("string") if shown is None else shown).alias("text"),
        (none.cast("double") if price is None else price).alias("price"),
        (none.cast("string") if currency is None else currency).alias("currency"),
        F.lit(how).alias("how"),
    )


def _money(found: Column) -> Column:
    """A found price as a candidate."""
    return let(found, lambda p: _candidate(None, p["price"], p["currency"]))


def _text_candidate(t: Column, currency: Column | None = None, how: str = "plain") -> Column:
    """A text still to be parsed (see :func:`_settle`), with a known currency if there is one."""
    return _candidate(t, None, currency, how)


def _number_candidate(value: Column, currency: Column | None = None) -> Column:
    return _candidate(None, value, currency)


def _price_rule(r: Rule) -> Column:
    """Candidate ``(text, price, currency)`` of one rule."""
    html = F.col("html")
    kinds = {
        "objects": lambda: _money(F.col("_ldprice")),
        "state": lambda: _money(o.price_from_objects(F.col("_state"))),
        "script": lambda: _number_candidate(
            F.regexp_extract("_allscripts", r.pattern, 1).try_cast("double"),
            blank_to_null(F.upper(F.regexp_extract("_allscripts", "\"(?:currency_code|price_currency|priceCurrency)\"\\s*:\\s*\"([A-Z]{3})\"", 1))),
        ),
        "meta": lambda: _meta_candidate(r.pattern),
        "element": lambda: _text_candidate(blank_to_null(_picked(r.pattern))),
        "lenient": lambda: _text_candidate(_picked(r.pattern), how="lenient"),
        "attr": lambda: _number_candidate(F.replace(_picked(r.pattern), F.lit(","), F.lit(".")).try_cast("double")),
        "html_price": lambda: _text_candidate(_picked(r.pattern), how="any"),
        "universal": lambda: _money(F.col("_universal")),
        "matched": lambda: _money(
            o.matched_price(
                F.col("_objects" if r.pattern == "objects" else "_state"), F.col("_pid"), "position" if r.pattern == "objects" else "high"
            )
        ),
        "nearby": lambda: _money(nearby_price(F.col("_allscripts"), F.col("_pid"))),
        "scored": lambda: _money(
            scored_best(
                scored_candidates(html, SCORED_PAYLOAD, F.lit(None).cast("string"), 14)
                if r.pattern == "payload"
                else scored_candidates(F.col("_allscripts"), SCORED_SCRIPTS, _slug())
            )
        ),
        "lines": lambda: _money(labeled_price(F.filter("_lines", lambda t: F.length(t) <= 220))),
        "anchor": lambda: _money(anchor_price(F.filter("_lines", lambda t: F.length(t) <= 160))),
    }
    return kinds[r.kind]()


def _settle(candidates: Column, lenient: bool = True) -> Column:
    """First candidate with a positive price; texts are parsed and checked here, once.

    ``plain`` texts are numbers or plausible prices, ``lenient`` ones prices in any form
    (of rules of sites only) and ``any`` ones prices without a check.
    """

    def price(c: Column) -> Column:
        return let(h.text_of(c["text"]), lambda t: settled(c, t))

    def settled(c: Column, shown: Column) -> Column:
        number = F.replace(shown, F.lit(","), F.lit("")).try_cast("double")
        plain = F.when((c["how"] == "plain") & (number > 0), F.struct(number.alias("price"), F.lit(None).cast("string").alias("currency")))
        fair = lambda p: (c["how"] == "any") | (~has_any(F.lower(shown), fixed.PRICE_STOP_WORDS) & price_in_limits(p))
        checked = let(parse_price(shown), lambda p: F.when(p["price"].isNotNull() & fair(p), p))
        parsed = F.coalesce(plain, F.when(c["how"] != "lenient", checked))
        if lenient:
            parsed = F.when(c["how"] == "lenient", parse_price_lenient(shown)).otherwise(parsed)
        own = F.when(c["price"] > 0, F.struct(c["price"].alias("price"), c["currency"].alias("currency")))
        known = let(
            parsed,
            lambda p: F.when(
                p["price"] > 0,
                F.struct(p["price"].alias("price"), F.coalesce(c["currency"], p["currency"]).alias("currency")),
            ),
        )
        return F.when(c["text"].isNull(), own).otherwise(known)

    return _first(F.transform(candidates, price))


def _title_rule(r: Rule) -> Column:
    """Raw title of one rule; :func:`_read_title` cleans it."""
    return {
        "objects": lambda: o.name_from_objects(F.col("_objects")),
        "heading": lambda: F.col("_page.h1"),
        "meta": lambda: h.meta_get(F.col("_entries"), *r.pattern.split(",")),
        "element": lambda: _picked(r.pattern),
    }[r.kind]()


def _read_title(raw: Column) -> Column:
    def clean(t: Column) -> Column:
        out = F.when(t == "", F.lit(None).cast("string"))
        for site in ("ebay", "therealreal", "poshmark"):
            out = out.when(F.col("site") == site, clean_title(t, site))
        return out.otherwise(t)

    return let(h.text_of(text(raw)), clean)


def _status_rule(r: Rule) -> Column:
    word = F.lit("Sold" if r.field == "sold" else "Available")
    if r.kind == "objects":
        return o.status_from_objects(F.col("_objects"), strict=r.site in STRICT_AVAILABILITY)
    if r.kind == "matched_status":
        return o.matched_status(F.col("_objects"), F.col("_pid"))
    hit = {
        "text": lambda: F.col("_text").rlike(r.pattern),
        "has": lambda: F.coalesce(*[_picked(k) for k in r.pattern.split(" || ")]).isNotNull(),
        "script_has": lambda: F.exists("_scripts", lambda x: x.contains(r.pattern.split("||")[0]) & x.rlike(r.pattern.split("||")[1])),
        "value": lambda: F.col("_p").isNotNull(),
        "any_sold": lambda: F.exists("_objects", lambda x: F.lower(text(x["availability"])).rlike("out ?of ?stock|sold ?out|unavailable|no longer available")),
    }[r.kind]()
    return F.when(hit, word)


def _condition_rule(r: Rule) -> Column:
    """Candidate ``(how, text)`` of one rule."""
    element = lambda: _picked(r.pattern)
    how, value = {
        "element": lambda: ("norm", element()),
        "attr": lambda: ("norm", element()),
        "script": lambda: ("norm", F.regexp_extract("_allscripts", r.pattern, 1)),
        "described": lambda: ("described", element()),
        "labeled": lambda: ("labeled", element()),
        "rank": lambda: ("rank", F.regexp_extract(F.col("_text"), r.pattern, 1)),
    }[r.kind]()
    return F.struct(F.lit(how).alias("how"), value.alias("text"))


def _read_condition(c: Column) -> Column:
    def read(t: Column) -> Column:
        found = F.struct(condition_from_text(t).alias("words"), labeled_condition(t).alias("label"))
        bare = F.regexp_replace(t, "(?i)^condition\\s*:?\\s*", "")
        return (
            F.when(t == "", F.lit(None).cast("string"))
            .when(c["how"] == "norm", condition_norm(bare))
            .when(c["how"] == "rank", condition_rank(t))
            .otherwise(
                let(
                    found,
                    lambda f: F.when(c["how"] == "described", F.coalesce(f["words"], f["label"])).otherwise(
                        F.coalesce(f["label"], f["words"])
                    ),
                )
            )
        )

    return let(h.text_of(text(c["text"])), read)


def _per_site(compile_rule, rules: Iterable[Rule], fields: tuple[str, ...], join=F.coalesce) -> Column:
    """One expression: the rules of the page's own site, in level order."""
    out = None
    by_site: dict[str, list[Rule]] = {}
    for r in rules:
        if r.field in fields:
            by_site.setdefault(r.site, []).append(r)
    for site, own in by_site.items():
        value = join(*[compile_rule(r) for r in sorted(own, key=lambda r: r.level)])
        out = F.when(F.col("site") == site, value) if out is None else out.when(F.col("site") == site, value)
    return out


def _literal_by_site(table: dict) -> Column:
    out = F.lit(None).cast("string")
    for site, value in table.items():
        if value is not None:
            out = F.when(F.col("site") == site, F.lit(value)).otherwise(out)
    return out


def _page_currency() -> Column:
    t = F.upper(F.col("_text"))
    return (
        F.when(t.rlike("€|EUR"), F.lit("EUR")).when(t.rlike("£|GBP"), F.lit("GBP")).when(t.rlike("\\$|USD"), F.lit("USD"))
    )


def condition_country(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Condition and country: site block, JSON-LD, meta, label pairs, then page text."""
    base = df.withColumn("_pairs", h.label_pairs(scanned=F.col("_page")))
    named = lambda p: blank_to_null(F.trim(F.regexp_extract("_shown", p, 1)))
    by_regex = lambda p: F.get(F.filter("_entries", lambda e: e["key"].rlike(p)), F.lit(0))["content"]
    plain = lambda c: F.struct(F.lit("norm").alias("how"), c.alias("text"))
    common = F.array(
        plain(o.first_value(F.col("_objects"), "condition")),
        plain(by_regex("(?i)(?:item)?condition")),
        plain(h.label_value(F.col("_pairs"), ["condition", "item condition"])),
        plain(named("(?i)\\bCondition\\b\\s*[:\\-]\\s*([A-Za-z][A-Za-z0-9 /'-]{1,60})")),
    )
    own = F.coalesce(_per_site(_condition_rule, rules, ("condition",), F.array), F.array().cast("array<struct<how:string,text:string>>"))
    places = ["country", "location", "ships from", "shipping from", "located in"]
    shop = F.regexp_extract("_allscripts", "Shopify\\.country\\s*=\\s*\"([A-Z]{2})\"", 1)
    buyer = _picked("[buyer-country=]@buyer-country")
    spots = F.array(
        o.first_value(F.col("_objects"), "country"),
        by_regex("(?i)(?:geo\\.)?country"),
        h.label_value(F.col("_pairs"), places),
        buyer,
        shop,
        h.meta_get(F.col("_entries"), "og:locale"),
        named("(?i)\\bLocated in\\b\\s*[:\\-]\\s*([A-Za-z ,.'-]{3,80})"),
        named("(?i)\\bShips from\\b\\s*[:\\-]\\s*([A-Za-z ,.'-]{3,80})"),
    )
    condition = _first(F.transform(F.concat(own, common), _read_condition))
    country = _first(F.transform(spots, country_norm))
    return base.withColumns({"condition": condition, "country": country}).drop("_pairs")


def listing_generic(df: DataFrame) -> DataFrame:
    """Generic listing columns ``g_title, g_price, g_currency, g_status`` of any page."""
    token = "(?i)[$€£]\\s*[0-9]{1,3}(?:[, ]?[0-9]{3})*(?:\\.[0-9]{2})?|[0-9]{1,3}(?:[, ]?[0-9]{3})*(?:\\.[0-9]{2})?\\s*(?:USD|EUR|GBP|CAD|AUD)"
    spots = F.transform(F.regexp_extract_all("_text", F.lit(token), F.lit(0)), lambda t: _text_candidate(t))
    first = F.array(
        _money(F.col("_ldprice")),
        _meta_candidate("price,product:price:amount,og:price:amount"),
        *[_text_candidate(blank_to_null(_picked(s))) for s in _PRICE_ELEMENTS],
    )
    price = _settle(F.concat(first, spots), lenient=False)
    sold = F.col("_text").rlike("\\bsold\\b|out of stock|unavailable|продано") | (
        o.status_from_objects(F.col("_objects")) == "Sold"
    )
    return df.withColumn("_g", price).withColumns(
        {
            "g_title": F.coalesce(o.first_value(F.col("_objects"), "name", lambda x: F.lower(text(x["type"])).contains("product")), h.meta_get(F.col("_entries"), "og:title"), h.heading(scanned=F.col("_page"))),
            "g_price": F.col("_g.price"),
            "g_currency": F.col("_g.currency"),
            "g_status": F.when(F.coalesce(sold, F.lit(False)), F.lit("Sold")).otherwise(F.lit("Available")),
        }
    ).drop("_g")


def extract_listings(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Parsed listings of pages ``(url, html)``; extra page columns are kept.

    Site rules first, the generic parser for what they lack.  Blocked, catalog, sold and
    mismatched pages leave early.  An optional ``blocked_hint`` marks pages whose
    diagnosis says blocked.
    """
    keep = [c for c in pages.columns if c not in ("html", "domain", "site")]
    base = pages if "blocked_hint" in pages.columns else pages.withColumn("blocked_hint", F.lit(False))
    fields = page_fields(with_site(base), rules).withColumns(
        {"_own": product_id_of("url"), "_canonical": product_id_of(h.canonical_url(scanned=F.col("_page"))), "_target": product_id_of(h.redirect_url("html"))}
    )
    fields = fields.withColumn("_pid", F.coalesce("_canonical", "_own"))
    meta = condition_country(fields, rules)
    generic_sites = sorted({r.site for r in rules if r.kind == "universal"})
    universal = F.when(
        F.col("site").isin(generic_sites),
        price_universal(F.col("_lines"), F.col("_ldprice"), F.col("_scripts"), text("html"), F.array(_picked("span.price"), _picked("div.price"))),
    )
    offers = meta.withColumn("_universal", universal).withColumn("_c", _per_site(_price_rule, rules, ("price",), F.array))
    priced = offers.withColumns({"_p": _settle(F.col("_c")), "_t": _first(F.transform(_per_site(_title_rule, rules, ("title",), F.array), _read_title))})
    status = F.coalesce(_per_site(_status_rule, rules, ("sold", "available")), _literal_by_site(DEFAULT_STATUS))
    found = listing_generic(priced.withColumn("_s", status))
    guessed = F.when(F.col("site") == "vestiairecollective", _page_currency()).otherwise(_literal_by_site(DEFAULT_CURRENCY))
    sold = listing_is_sold("_s")
    void = F.col("site").isin(SOLD_VOIDS_PRICE) & sold
    mismatch = (F.col("site") == "theluxurycloset") & redirect_mismatch(F.col("_own"), F.col("_canonical"), F.col("_target"))
    no_signal = ~F.col("html").rlike("(?i)pdp_buy_btn|add[-_]to[-_]bag|product:price:amount|og:price:amount|\"@type\"\\s*:\\s*\"Product\"")
    catalog = F.col("_p").isNull() & no_signal & is_catalog_page(F.col("site"), F.col("html"))
    soft = F.col("site").isin(*SOFT_SITES)
    product = F.col("html").rlike(PRODUCT_SIGNALS) | F.coalesce(*[_picked(k) for k in PRODUCT_TAGS]).isNotNull()
    marked = has_any(F.col("_text"), fixed.BLOCKED_TITLE_MARKERS) & ~product
    blocked = (F.col("blocked_hint") & ~soft) | (soft & marked)
    closed = blocked | void | mismatch | catalog | (soft & sold & F.col("_p").isNull())
    own_price = F.when(~closed, F.col("_p.price"))
    price = F.when(~closed, F.coalesce(own_price, F.col("g_price")))
    currency = F.when(
        price.isNotNull(),
        F.when(own_price.isNotNull(), F.coalesce("_p.currency", guessed, F.lit("USD"))).otherwise(F.coalesce("g_currency", guessed, F.lit("USD"))),
    )
    merged = found.withColumns(
        {
            "title": F.when(~catalog & ~blocked, F.coalesce(blank_to_null(F.trim(text("_t"))), F.col("g_title"))),
            "price": price,
            "currency": currency,
            "status": F.when(blocked, F.lit("blocked"))
            .when(catalog, F.lit("catalog"))
            .when(mismatch, F.lit(None).cast("string")).otherwise(F.coalesce("_s", "g_status")),
        }
    )
    done = with_fallback_meta(override_blocked(merged))
    return done.select(*[c for c in keep], "domain", "site", "title", "price", "currency", "status", "condition", "country")


def page_snapshot(df: DataFrame, budget: int = 9000) -> DataFrame:
    """Compact page text of distinct telling lines under a character budget."""
    cut = lambda c, n: clean_text(c, n)
    wanted = ["title", "price", "amount", "currency", "availability", "stock", "condition", "product"]
    page = F.col("_page")
    metas = F.transform(
        F.filter(h.meta_entries(scanned=page), lambda e: has_any(e["key"], wanted)),
        lambda e: F.concat(F.lit("<meta "), e["key"], F.lit('="'), cut(e["content"], 260), F.lit('">')),
    )
    data = F.transform(h.jsonld_texts(scanned=page), lambda t: F.concat(F.lit("<script>"), cut(t, 1800), F.lit("</script>")))
    tags = F.transform(page["telling"], lambda t: cut(t, 220))
    title = F.concat(F.lit("<title>"), F.coalesce(h.page_title(scanned=page), F.lit("")), F.lit("</title>"))
    body = F.concat(F.lit("<text>"), cut(h.shown_text(scanned=page), 1600), F.lit("</text>"))
    lines = F.filter(F.array_distinct(F.concat(F.array(title), metas, data, tags, F.array(body))), lambda t: F.length(t) >= 4)
    start = F.struct(F.lit(budget).alias("left"), F.expr("array()").cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        fitted = F.when(F.length(line) + 1 > acc["left"], F.rtrim(F.substring(line, F.lit(1), F.greatest(acc["left"] - 1, F.lit(0))))).otherwise(line)
        take = (acc["left"] > 0) & (F.length(fitted) >= 4)
        return F.struct(
            F.when(take, acc["left"] - F.length(fitted) - 1).otherwise(acc["left"]).alias("left"),
            F.when(take, F.concat(acc["out"], F.array(fitted))).otherwise(acc["out"]).alias("out"),
        )

    snapshot = F.aggregate(lines, start, step, lambda acc: F.array_join(acc["out"], "\n"))
    return df.withColumn("_page", h.page("html")).withColumn("snapshot", snapshot).drop("html", "_page")


def extracted_record(df: DataFrame, json: str = "record", current_currency: str | None = None) -> DataFrame:
    """Cleaned fields of an extraction record given as JSON.

    Empty markers become null, alternative key names are accepted, and the price may be
    a number or a text.
    """
    v = F.try_parse_json(F.col(json))
    get = lambda *keys: F.coalesce(*[blank_to_null(F.trim(F.try_variant_get(v, f"$.{k}", "string"))) for k in keys])
    clean = lambda c, n: let(clean_text(c, n), lambda t: F.when(~F.lower(t).isin(fixed.EMPTY_MARKERS), t))
    known = currency_code(current_currency) if current_currency else F.lit(None).cast("string")

    def money(r: Column) -> Column:
        shown, extra = parse_price(r["price"]), parse_price(r["text"])
        number = F.regexp_replace(r["price"], "[, ]", "").try_cast("double")
        value = F.coalesce(r["price"].try_cast("double"), shown["price"], number, extra["price"])
        currency = F.coalesce(currency_code(r["currency"]), currency_code(shown["currency"]), currency_code(extra["currency"]))
        good = F.when(value > 0, value)
        return F.struct(
            good.alias("price"), F.coalesce(currency, F.when(good.isNotNull(), F.coalesce(known, F.lit("USD")))).alias("currency")
        )

    raw = F.struct(
        get("price").alias("price"),
        get("price_text", "price_raw").alias("text"),
        get("currency", "currency_code", "price_currency").alias("currency"),
    )
    return df.withColumn("_m", let(raw, money)).select(
        *[c for c in df.columns if c != json],
        clean(get("title", "name", "product_name"), 260).alias("title"),
        F.col("_m.price").alias("price"),
        F.col("_m.currency").alias("currency"),
        clean(get("status", "availability"), 80).alias("status"),
        clean(get("condition", "item_condition"), 90).alias("condition"),
    )
