"""Search payloads to candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.base import blank_to_null, let, text
from ..functions.money import parse_price
from ..functions.urls import domain_of, likely_sold
from ..operators.lookups import filter_supported
from ..schemas import SEARCH_ITEM, SEARCH_PAYLOAD, SECTIONS

_PRICE_FIELDS = ("price", "extracted_price", "price_with_symbol", "price_str")


def _filled(c: Column) -> Column:
    return blank_to_null(text(c))


def _shown(item: Column, fields: tuple[str, ...]) -> Column:
    return F.coalesce(*[_filled(item[f]) for f in fields], F.lit(""))


def _item_price(item: Column, shown: Column) -> Column:
    """Price text, else the numeric field in USD, else a price inside the title."""
    number = item["extracted_price"].try_cast("double")

    def titled(p: Column) -> Column:
        """Only items that state no price have their title searched."""
        currency = lambda t: F.when(t["price"].isNotNull(), F.coalesce(t["currency"], p["shown"]["currency"])).otherwise(p["shown"]["currency"])
        return let(parse_price(item["title"]), lambda t: F.struct(t["price"].alias("price"), currency(t).alias("currency")))

    def pick(p: Column) -> Column:
        return (
            F.when(p["shown"]["price"].isNotNull(), p["shown"])
            .when(
                p["number"].isNotNull(),
                F.struct(p["number"].alias("price"), F.lit("USD").alias("currency")),
            )
            .otherwise(titled(p))
        )

    parts = F.struct(parse_price(shown).alias("shown"), number.alias("number"))
    return let(parts, pick)


def parse_payloads(df: DataFrame, json: str = "payload") -> DataFrame:
    return df.withColumn("payload", F.from_json(json, SEARCH_PAYLOAD))


def payload_rows(df: DataFrame, json: str = "payload", legacy: bool = False) -> DataFrame:
    """Every item of every section, in section order, not yet merged by link.

    A payload is parsed once; its sections are put together with their number and
    exploded in one pass.
    """
    parsed = parse_payloads(df, json)

    def entries(rank: int) -> Column:
        section = F.col(f"payload.{SECTIONS[rank]}")
        return F.transform(F.coalesce(section, F.array().cast(f"array<{SEARCH_ITEM}>")), lambda x, i: F.struct(F.lit(rank).alias("section_rank"), i.alias("pos"), x.alias("item")))

    ranks = [r for r, name in enumerate(SECTIONS) if not (legacy and name == "exact_matches")]
    rows = parsed.select("analysis_id", F.inline(F.concat(*[entries(r) for r in ranks]))).filter(F.col("item").isNotNull())
    item, rank = F.col("item"), F.col("section_rank")
    organic, shopping = rank == SECTIONS.index("organic_results"), rank == SECTIONS.index("shopping_results")
    shown = _shown(item, _PRICE_FIELDS)
    if legacy:
        shown = (
            F.when(organic, _shown(item, ("price", "extracted_price")))
            .when(shopping, _shown(item, ("extracted_price", "price", "price_with_symbol", "price_str")))
            .otherwise(shown)
        )
    link = F.coalesce(_filled(item["link"]), F.when(rank < 2, _filled(item["source"])), F.lit(""))
    out = rows.select(
        "analysis_id",
        "section_rank",
        "pos",
        F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), rank + 1).alias("serp_source"),
        link.alias("url"),
        F.coalesce(_filled(item["thumbnail"]), _filled(item["image"]), F.lit("")).alias("image"),
        text(item["title"]).alias("title"),
        _item_price(item, shown).alias("_price"),
    )
    if not legacy:
        out = out.filter((rank != SECTIONS.index("organic_results")) | domain_of("url").isin(*fixed.SITE_BY_DOMAIN))
    return out.select("*", F.col("_price.price").alias("serp_price"), F.col("_price.currency").alias("serp_currency")).drop("_price")


def read_search_results(df: DataFrame, json: str = "payload", legacy: bool = False, drop_sold: bool = False) -> DataFrame:
    """Candidates of the search payloads in ``df`` (``analysis_id`` and a JSON column).

    Rows of the same link become one row; ``legacy`` payloads have no exact section,
    carry a guessed status and keep repeated links of the visual and shopping sections.
    """
    from ..operators.candidates import merge_by_link

    rows = payload_rows(df, json, legacy)
    if drop_sold:
        rows = rows.filter(~likely_sold("url", "title"))
    if not legacy:
        return merge_by_link(rows)
    return _legacy(rows)


def legacy_status(title: Column, url: Column) -> Column:
    """Status words guessed from title and link; "unavailable" reads as available."""
    t, u = F.lower(title), F.lower(url)
    return (
        F.when(t.contains("sold") | u.contains("sold"), F.lit("продан"))
        .when(t.contains("available") | t.contains("in stock"), F.lit("в наличии"))
        .when(t.contains("out of stock"), F.lit("нет в наличии"))
        .otherwise(F.lit("неизвестно"))
    )


def _legacy(rows: DataFrame) -> DataFrame:
    """Rows of legacy payloads; read once, and only those that depend on others of their link move.

    These are organic rows, which stay if they are the first of their link, and rows before the
    shopping section without a price, which take that of the first priced organic row if they are.
    """
    from ..operators.groups import staged

    offer = F.struct("serp_price", F.coalesce("serp_currency", F.lit("USD")).alias("serp_currency"), "status")
    place = F.struct("section_rank", "pos")
    named = staged(rows.filter(F.col("url") != "").withColumn("status", legacy_status(F.col("title"), F.col("url"))))
    organic, shopping = F.col("serp_source") == "organic_results", F.col("serp_source") == "shopping_results"
    asks = organic | F.col("serp_price").isNull()
    early = named.filter(~shopping & F.col("analysis_id").isNotNull())
    link = [F.xxhash64("analysis_id", "url").alias("_h1"), F.xxhash64(F.lit("second"), "analysis_id", "url").alias("_h2")]
    per_link = early.groupBy(*link).agg(
        F.min(place).alias("_first"),
        F.min_by(offer, F.when(organic & F.col("serp_price").isNotNull(), place)).alias("_fill"),
    )
    joined = early.filter(asks).select("*", *link).join(per_link, ["_h1", "_h2"])
    is_first = place == F.col("_first")
    fill = is_first & F.col("serp_price").isNull() & F.col("_fill").isNotNull()
    own = F.struct("serp_price", "serp_currency", "status")
    filled = joined.filter(~organic | is_first).withColumn("_o", F.when(fill, F.col("_fill")).otherwise(own))
    columns = ["analysis_id", "section_rank", "pos", "serp_source", "url", "image", "title"]
    others = named.filter(shopping | (~asks & F.col("analysis_id").isNotNull())).select(*columns, "serp_price", "serp_currency", "status")
    return filled.select(*columns, "_o.*").unionByName(others).withColumn("serp_currency", F.coalesce("serp_currency", F.lit("USD")))


def merge_payloads(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Section-wise union of two sets of payload rows, distinct by link, base first.

    Rows without a link are all kept.
    """
    from ..operators.groups import first_rows

    both = base.withColumn("_src", F.lit(0)).unionByName(extra.withColumn("_src", F.lit(1)))
    linkless = F.concat_ws("#", F.lit(""), "_src", "section_rank", "pos")
    keyed = both.withColumn("_link", F.when(F.trim("url") == "", linkless).otherwise(F.trim("url")))
    order = [F.col("_src"), F.col("pos")]
    return first_rows(keyed, ["analysis_id", "section_rank", "_link"], order).drop("_src", "_link")


def payload_stats(rows: DataFrame) -> DataFrame:
    """Items per section and distinct supported links per analysis."""
    supported = filter_supported(rows.filter(F.trim("url") != "").withColumn("domain", domain_of("url")))
    links = supported.groupBy("analysis_id").agg(F.count_distinct(F.trim("url")).alias("supported_links"))
    counts = rows.groupBy("analysis_id").agg(
        *[F.count_if(F.col("serp_source") == s).alias(s) for s in SECTIONS], F.count(F.lit(1)).alias("total")
    )
    return counts.join(links, "analysis_id", "left").fillna(0, ["supported_links"])


def needs_more_results(
    stats: DataFrame, min_supported: int = 10, min_total: int = 30, min_visual: int = 45, min_visual_supported: int = 5
) -> DataFrame:
    """Whether a wider search is still needed."""
    enough = (F.col("supported_links") >= min_supported) & (F.col("total") >= min_total)
    visual = (
        F.lit(min_visual > 0)
        & (F.col("visual_matches") >= min_visual)
        & (F.col("supported_links") >= min_visual_supported)
    )
    return stats.withColumn("needs_more", ~(enough | visual))
