"""Queries: parsed listings, price precedence and listing merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import listings as ls
from ..operators.lookups import to_usd
from .fixtures import fixture
from .registry import any_like, cte, query, rnd

_NORM = f"""CASE WHEN status IS NULL THEN NULL WHEN status = 'blocked' THEN 'Blocked'
    WHEN {any_like('lower(status)', fixed.STATUS_SOLD)} THEN 'Sold' WHEN {any_like('lower(status)', fixed.STATUS_AVAILABLE)} THEN 'Available'
    WHEN contains(lower(status), 'catalog') THEN 'Catalog' WHEN lower(status) = 'unknown' THEN 'Unknown' ELSE status END"""
cte("normed", f"SELECT *, {_NORM} AS st, domain IN ('yoogiscloset.com', 'fashionphile.com') AS two FROM @parsed")
cte(
    "resolved",
    """SELECT *, CASE WHEN src = 'page' THEN page_price WHEN src = 'search' THEN serp_price END AS price,
        CASE WHEN src = 'page' THEN coalesce(page_currency, 'USD') WHEN src = 'search' THEN coalesce(serp_currency, 'USD') END AS currency
        FROM (SELECT *, CASE WHEN page_price > 20 AND NOT coalesce(two AND st = 'Sold', FALSE) THEN 'page'
           WHEN st = 'Blocked' OR coalesce(two AND st = 'Sold', FALSE) THEN NULL
           WHEN (st = 'Sold' AND serp_price > 0) OR (st IS DISTINCT FROM 'Sold' AND serp_price > 20) THEN 'search' END AS src FROM @normed)""",
)
_RATE = "CASE currency WHEN 'EUR' THEN 0.92E0 WHEN 'GBP' THEN 0.79E0 END"
cte("usd", f"SELECT *, CASE WHEN currency = 'USD' THEN price ELSE {rnd(f'price / {_RATE}')} END AS usd FROM @resolved")
cte(
    "sane",
    """SELECT *, CASE WHEN usd >= 20 THEN usd END AS price_usd, CASE WHEN usd < 20 THEN NULL ELSE price END AS p2,
        CASE WHEN usd < 20 THEN NULL ELSE currency END AS c2 FROM @usd""",
)


@query("resolve_price", "SELECT pos, price, currency, src AS price_source FROM @resolved")
def resolve_price(spark, d):
    return ls.resolve_price(fixture(spark, d, "parsed")).select("pos", "price", "currency", "price_source")


def _sane(spark, d):
    priced = to_usd(ls.resolve_price(fixture(spark, d, "parsed")), fixture(spark, d, "rates"), "price", "currency")
    return ls.usd_sanity(priced)


@query("usd_sanity", "SELECT pos, price_usd, p2 AS price, c2 AS currency FROM @sane")
def usd_sanity(spark, d):
    return _sane(spark, d).select("pos", "price_usd", "price", "currency")


@query(
    "final_status",
    "SELECT pos, coalesce(st, CASE WHEN price_usd IS NOT NULL OR p2 IS NOT NULL THEN 'Available' ELSE 'Unknown' END) AS status FROM @sane",
)
def final_status(spark, d):
    return ls.final_status(_sane(spark, d)).select("pos", "status")


@query(
    "items_from_listings",
    f"""SELECT pos, {rnd('price_usd')} AS price, {rnd('p2')} AS price_original, c2 AS currency_original, 'USD' AS currency,
        coalesce(st, CASE WHEN p2 IS NOT NULL THEN 'Available' ELSE 'Unknown' END) AS status FROM @sane
        WHERE st IS DISTINCT FROM 'Catalog' AND st IS DISTINCT FROM 'Sold'""",
)
def items_from_listings(spark, d):
    out = ls.items_from_listings(fixture(spark, d, "parsed"), fixture(spark, d, "rates"), filter_sold=True)
    return out.select("pos", "price", "price_original", "currency_original", "currency", "status")


@query("drop_catalog", "SELECT pos FROM @normed WHERE st IS DISTINCT FROM 'Catalog'")
def drop_catalog(spark, d):
    return ls.drop_catalog(fixture(spark, d, "parsed")).select("pos")


@query("drop_sold", "SELECT pos FROM @normed WHERE st IS DISTINCT FROM 'Sold'")
def drop_sold(spark, d):
    return ls.drop_sold(fixture(spark, d, "parsed")).select("pos")


@query(
    "null_sold_price",
    "SELECT pos, CASE WHEN coalesce(two AND st = 'Sold', FALSE) THEN NULL ELSE page_price END AS price FROM @normed",
)
def null_sold_price(spark, d):
    rows = fixture(spark, d, "parsed").withColumnsRenamed({"page_price": "price", "page_currency": "currency"})
    return ls.null_sold_price(rows).select("pos", "price")


@query(
    "needs_refine",
    """SELECT pos, (page_price IS NULL AND st IS DISTINCT FROM 'Sold') OR st IS NULL AS quick,
        (page_price IS NULL AND st IS DISTINCT FROM 'Sold') OR st IS NULL OR coalesce(condition, '') = '' AS full FROM @normed""",
)
def needs_refine(spark, d):
    return fixture(spark, d, "parsed").select(
        "pos", ls.needs_refine().alias("quick"), ls.needs_refine(require_condition=True).alias("full")
    )


@query(
    "missing_fields",
    f"""SELECT pos, array_to_string(list_filter([CASE WHEN coalesce(status, '') = '' THEN 'status' END,
        CASE WHEN nop THEN 'price' END, CASE WHEN (page_price IS NOT NULL OR nop) AND page_currency IS NULL THEN 'currency' END,
        CASE WHEN coalesce(condition, '') = '' THEN 'condition' END], lambda x: x IS NOT NULL), ',') AS missing
        FROM (SELECT *, page_price IS NULL AND NOT coalesce({any_like('lower(status)', fixed.LISTING_SOLD)}, FALSE) AS nop FROM @parsed)""",
)
def missing_fields(spark, d):
    rows = fixture(spark, d, "parsed").withColumnsRenamed({"page_price": "price", "page_currency": "currency"})
    return rows.select("pos", F.array_join(ls.missing_fields(), ",").alias("missing"))


def _two_parses(spark, d):
    rows = fixture(spark, d, "parsed").withColumn("url", F.col("pos").cast("string"))
    make = lambda price, cur, status, cond: rows.select(
        "url",
        F.when(F.col("partkey") % 3 > 0, F.col("title")).alias("title"),
        price.alias("price"),
        cur.alias("currency"),
        status.alias("status"),
        cond.alias("condition"),
        F.lit(None).cast("string").alias("country"),
    )
    one = make(F.col("page_price"), F.col("page_currency"), F.col("status"), F.col("condition"))
    two = make(F.col("serp_price"), F.col("serp_currency"), F.lit("Available"), F.lit("New"))
    return one, two


_MERGED = """SELECT CAST(pos AS VARCHAR) AS url, coalesce(page_price, {serp}) AS price, coalesce(page_currency, serp_currency) AS currency,
    coalesce({status}, 'Available') AS status, CASE WHEN coalesce(condition, '') = '' THEN 'New' ELSE condition END AS condition,
    CASE WHEN partkey % 3 > 0 THEN title END AS title FROM @parsed"""
_COLUMNS = ("url", "price", "currency", "status", "condition", "title")


@query("merge_listings", _MERGED.format(status="status", serp="serp_price"))
def merge_listings(spark, d):
    return ls.merge_listings(*_two_parses(spark, d)).select(*_COLUMNS)


@query("fill_missing", _MERGED.format(status="status", serp="CASE WHEN serp_price > 0 THEN serp_price END"))
def fill_missing(spark, d):
    return ls.fill_missing(*_two_parses(spark, d)).select(*_COLUMNS)


@query("merge_api_page", _MERGED.format(status="CASE WHEN lower(status) <> 'unknown' THEN status END", serp="serp_price"))
def merge_api_page(spark, d):
    page, api = _two_parses(spark, d)
    return ls.merge_api_page(api, page).select(*_COLUMNS)


@query(
    "override_blocked",
    """SELECT pos, CASE WHEN partkey % 2 = 0 AND linenumber = 5 AND page_price IS NULL AND coalesce(lower(status), '') IN ('', 'unknown') THEN 'blocked' ELSE status END AS status
       FROM @parsed""",
)
def override_blocked(spark, d):
    rows = fixture(spark, d, "parsed").withColumns(
        {
            "price": F.col("page_price"),
            "blocked_hint": F.col("partkey") % 2 == 0,
            "title": F.when(F.col("linenumber") == 5, F.lit("Just a moment...")).otherwise(F.col("title")),
        }
    )
    return ls.override_blocked(rows).select("pos", "status")


@query(
    "redirect_mismatch",
    """SELECT pos, coalesce((partkey % 3 <> 0 AND partkey % 4 = 0) OR (linenumber = 3 AND partkey % 3 <> 0), FALSE) AS mismatch FROM @parsed""",
)
def redirect_mismatch(spark, d):
    rows = fixture(spark, d, "parsed")
    own = F.when(F.col("partkey") % 3 != 0, F.col("partkey"))
    canonical = F.when(F.col("partkey") % 4 == 0, F.col("partkey") + 1).when(F.col("partkey") % 4 == 1, F.col("partkey"))
    redirect = F.when(F.col("linenumber") == 3, F.col("partkey") + 2)
    return rows.select("pos", ls.redirect_mismatch(own, canonical, redirect).alias("mismatch"))


def _price_cands(spark, d):
    return fixture(spark, d, "listings").select(
        F.col("orderkey").alias("page_id"), (F.col("linenumber") % 3 * 10).alias("score"),
        (F.col("linenumber") % 2).alias("priority"), "pos", F.col("price_original").alias("price"),
        F.col("currency_original").alias("currency"),
    )


for _tie, _order in {
    "low": "-(linenumber % 3 * 10), price_original",
    "high": "-(linenumber % 3 * 10), -price_original",
    "position": "-(linenumber % 3 * 10), pos",
    "priority": "linenumber % 2, pos",
}.items():

    @query(
        f"best_price_{_tie}",
        f"SELECT orderkey AS page_id, arg_min(price_original, ({_order})) AS price, arg_min(currency_original, ({_order})) AS currency FROM @listings GROUP BY 1",
    )
    def best_price(spark, d, tie=_tie):
        return ls.best_price(_price_cands(spark, d), ["page_id"], tie)


@query(
    "unparsed_pages",
    "SELECT url, html FROM {pages} WHERE page_id % 7 = 0",
)
def unparsed_pages(spark, d):
    from .fixtures import load

    pages = load(spark, d, "pages")
    parsed = pages.select(
        "page_id",
        F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("title"),
        F.lit(None).cast("double").alias("price"),
    )
    return ls.unparsed_pages(parsed, pages).select("url", "html")
