"""Parsed listings to final items: price precedence, sanity, status, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.base import blank_to_null, has_any, let, text
from ..functions.money import parse_price
from ..functions.status import condition_from_title, is_status, listing_is_sold, status_norm
from ..functions.urls import country_of_url
from .lookups import to_usd


def null_sold_price(df: DataFrame, domains: list[str] = fixed.SOLD_WITHOUT_PRICE_DOMAINS) -> DataFrame:
    """Sold pages of the given domains lose their price and currency."""
    hit = F.col("domain").isin(domains) & is_status("status", "Sold")
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in ("price", "currency")})


def resolve_price(
    df: DataFrame, domains: list[str] = fixed.SOLD_WITHOUT_PRICE_DOMAINS, floor: float = 20.0
) -> DataFrame:
    """Price of a row from page, search result or title, in this order.

    Reads ``page_price, page_currency, serp_price, serp_currency, title, status, domain``;
    adds ``price, currency, price_source``.  Sold rows accept any positive search price,
    except on ``domains``; blocked rows use the page price only.
    """
    sold, blocked = F.col("_sold"), F.col("_blocked")
    silent = F.col("domain").isin(domains) & sold
    page = F.when((F.col("page_price") > floor) & ~silent, F.col("page_price"))
    enough = F.when(sold, F.col("serp_price") > 0).otherwise(F.col("serp_price") > floor)
    serp = F.when(~blocked & ~silent & enough, F.col("serp_price"))
    lend = lambda v, cur, src: F.when(
        v.isNotNull(), F.struct(v.alias("price"), cur.alias("currency"), F.lit(src).alias("price_source"))
    )
    titled = F.when(
        ~blocked & ~silent,
        let(
            parse_price("title"),
            lambda p: F.when(
                p["price"] > floor,
                F.struct(
                    p["price"].alias("price"),
                    F.coalesce(p["currency"], F.lit("USD")).alias("currency"),
                    F.lit("title").alias("price_source"),
                ),
            ),
        ),
    )
    chosen = F.coalesce(
        lend(page, F.coalesce("page_currency", F.lit("USD")), "page"),
        lend(serp, F.coalesce("serp_currency", F.lit("USD")), "search"),
        titled,
    )
    flagged = df.withColumns({"_sold": is_status("status", "Sold"), "_blocked": is_status("status", "Blocked")})
    return flagged.withColumn("_p", chosen).select(*df.columns, "_p.*")


def usd_sanity(df: DataFrame, floor: float = 20.0) -> DataFrame:
    """Drop tiny USD prices and tiny unconverted rand prices, with their originals."""
    reject = (F.col("price_usd") < floor) | (
        F.col("price_usd").isNull() & (F.upper("currency") == "ZAR") & (F.col("price") < 100)
    )
    keep = ~F.coalesce(reject, F.lit(False))
    return df.withColumns({c: F.when(keep, F.col(c)) for c in ("price_usd", "price", "currency")})


def final_status(df: DataFrame) -> DataFrame:
    """Parsed status, else Available with any price, else Unknown."""
    priced = F.col("price_usd").isNotNull() | F.col("price").isNotNull()
    fallback = F.when(priced, F.lit("Available")).otherwise(F.lit("Unknown"))
    return df.withColumn("status", F.coalesce(status_norm("status"), fallback))


def drop_catalog(df: DataFrame) -> DataFrame:
    return df.filter(~is_status("status", "Catalog"))


def drop_sold(df: DataFrame) -> DataFrame:
    return df.filter(~is_status("status", "Sold"))


def needs_refine(
    price: str = "page_price", status: str = "status", condition: str = "condition", require_condition: bool = False
) -> Column:
    """A second crawl is useful: price missing while not sold, or status missing."""
    need = (F.col(price).isNull() & ~is_status(status, "Sold")) | status_norm(status).isNull()
    return need | (F.trim(text(condition)) == "") if require_condition else need


def missing_fields(with_condition: bool = True) -> Column:
    """Names of the fields a parsed listing lacks."""
    blank = lambda c: F.trim(text(c)) == ""
    no_price = F.col("price").isNull() & ~listing_is_sold("status")
    names = [
        F.when(blank("title"), F.lit("title")),
        F.when(blank("status"), F.lit("status")),
        F.when(no_price, F.lit("price")),
        F.when((F.col("price").isNotNull() | no_price) & blank("currency"), F.lit("currency")),
    ]
    if with_condition:
        names.append(F.when(blank("condition"), F.lit("condition")))
    return F.array_compact(F.array(*names))


def items_from_listings(df: DataFrame, rates: DataFrame, filter_sold: bool = False) -> DataFrame:
    """Final items: resolved price in USD, original price, five-valued status."""
    usable = df.withColumn(
        "title", F.when(F.col("page_title").isNull() | F.col("page_title").isin(fixed.BLOCKED_TITLES), F.col("title")).otherwise(F.col("page_title"))
    ) if "page_title" in df.columns else df
    priced = to_usd(resolve_price(drop_catalog(usable)), rates, "price", "currency", "price_usd")
    done = final_status(usd_sanity(priced))
    if filter_sold:
        done = drop_sold(done)
    return done.withColumns(
        {
            "price_original": F.round("price", 2),
            "currency_original": F.col("currency"),
            "price": F.round("price_usd", 2),
            "currency": F.lit("USD"),
        }
    ).drop("price_usd")


FIELDS = ("title", "price", "currency", "status", "condition", "country")


def _has(c: Column, name: str) -> Column:
    return c if name == "price" else blank_to_null(F.trim(text(c)))


def _joined(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    fields = [f for f in FIELDS if f in b.columns]
    return a.join(b.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key, "left")


def merge_listings(specific: DataFrame, generic: DataFrame, key: str = "url") -> DataFrame:
    """Field by field, the site parser's value before the generic one."""
    joined = _joined(specific, generic, key)
    out = {f: F.coalesce(_has(F.col(f), f), F.col(f"_{f}")) for f in FIELDS if f"_{f}" in joined.columns}
    return joined.withColumns(out).drop(*[f"_{f}" for f in FIELDS])


def fill_missing(base: DataFrame, extra: DataFrame, key: str = "url") -> DataFrame:
    """Only fields the base lacks are taken from ``extra``."""
    return merge_listings(base, extra.withColumn("price", F.when(F.col("price") > 0, F.col("price"))), key)


def merge_api_page(api: DataFrame, page: DataFrame, key: str = "url") -> DataFrame:
    """Page values first; a page status of Unknown gives way to the API's."""
    joined = _joined(page, api, key)
    known = F.when(~F.lower(F.trim(text("status"))).isin("", "unknown", "none"), F.col("status"))
    out = {f: F.coalesce(_has(F.col(f), f), F.col(f"_{f}")) for f in FIELDS}
    out["status"] = F.coalesce(known, F.col("_status"))
    return joined.withColumns(out).drop(*[f"_{f}" for f in FIELDS])


def with_fallback_meta(df: DataFrame) -> DataFrame:
    """Condition guessed from the title, country from the url, where still missing."""
    return df.withColumns(
        {
            "condition": F.coalesce("condition", condition_from_title("title")),
            "country": F.coalesce("country", country_of_url("url")),
        }
    )


def override_blocked(df: DataFrame, hint: str = "blocked_hint") -> DataFrame:
    """A blocked hint stands only without price and status and with a block-page title."""
    title = F.lower(F.trim(text("title")))
    looks_blocked = (title == "") | has_any(title, fixed.BLOCKED_TITLE_MARKERS)
    weak = F.lower(F.trim(text("status"))).isin("", "unknown", "none")
    stands = F.col(hint) & looks_blocked & F.col("price").isNull() & weak
    return df.withColumn("status", F.when(stands, F.lit("blocked")).otherwise(F.col("status")))


def redirect_mismatch(url_id: Column, canonical_id: Column, redirect_id: Column) -> Column:
    """The page belongs to another product than the requested url."""
    other = lambda c: F.coalesce(c != url_id, F.lit(False))
    return other(canonical_id) | other(redirect_id)


def best_price(cands: DataFrame, keys: list[str], tie: str = "low") -> DataFrame:
    """Best price candidate per key.

    Highest score first; ties by lowest price ("low"), highest price ("high") or input
    position ("position").  "priority" takes the lowest priority, then position.
    """
    by_score = -F.col("score")
    order = {
        "low": lambda: F.struct(by_score, F.col("price")),
        "high": lambda: F.struct(by_score, -F.col("price")),
        "position": lambda: F.struct(by_score, F.col("pos")),
        "priority": lambda: F.struct(F.col("priority"), F.col("pos")),
    }[tie]()
    return cands.groupBy(*keys).agg(F.min_by(F.struct("price", "currency"), order).alias("_b")).select(*keys, "_b.*")


def unparsed_pages(parsed: DataFrame, pages: DataFrame, key: str | None = None) -> DataFrame:
    """Pages that gave neither title nor price, with their html.

    ``key`` names a page in both tables: ``page_id`` where both have it, else the url, of
    which several fetches of a page share one.
    """
    key = key or ("page_id" if "page_id" in parsed.columns and "page_id" in pages.columns else "url")
    empty = parsed.filter((F.trim(text("title")) == "") & F.col("price").isNull()).select(key).distinct()
    return pages.join(empty, key, "left_semi")
