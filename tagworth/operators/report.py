"""Report tables: summary lines and numbered cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import blank_to_null, text
from ..functions.display import escape_html, money_text, percent_text, status_badge
from ..functions.status import condition_or_default
from ..functions.urls import safe_url
from .groups import rank_in_group
from .routing import place

SUMMARY_LABELS = (
    "Avito original price",
    "Avito price in USD",
    "Final median",
    "Available median",
    "Sold median",
    "All median",
    "Cards total",
)


def report_summary(results: DataFrame) -> DataFrame:
    """Seven labelled lines per analysis.

    Reads the four medians, ``cards_total`` and, if present, the asking price columns
    ``asking_price, asking_currency, asking_price_usd``.
    """
    have = set(results.columns)
    pick = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    usd = lambda c: money_text(pick(c, "double"), F.lit("USD"))
    values = [
        money_text(pick("asking_price", "double"), pick("asking_currency", "string")),
        usd("asking_price_usd"),
        usd("median_price_usd"),
        usd("median_price_available_usd"),
        usd("median_price_sold_usd"),
        usd("median_price_raw_usd"),
        F.coalesce(F.col("cards_total"), F.lit(0)).cast("string"),
    ]
    lines = F.array(
        *[F.struct(F.lit(i + 1).alias("line_no"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(zip(SUMMARY_LABELS, values))]
    )
    return results.select("analysis_id", F.inline(lines))


def report_cards(items: DataFrame, order: list[Column] | None = None, lead: Column | None = None) -> DataFrame:
    """Numbered cards with badge, condition, money and similarity texts, escaped for html."""
    order = order or place(items)
    shows = ["title", "site", "status", "price", "condition", "similarity", "price_original", "currency_original", "url"]
    cards = rank_in_group(items, ["analysis_id"], order, lead, "card_no", keep=shows)
    shown = lambda c, default: escape_html(F.coalesce(blank_to_null(text(c)), F.lit(default)))
    return cards.select(
        "analysis_id",
        "card_no",
        shown("title", "Untitled").alias("title"),
        shown("site", "N/A").alias("site"),
        status_badge("status", "price").alias("badge"),
        escape_html(condition_or_default("condition")).alias("condition"),
        percent_text("similarity").alias("similarity"),
        money_text("price", F.lit("USD")).alias("price_usd"),
        money_text("price_original", "currency_original").alias("price_original"),
        safe_url("url").alias("source_url"),
    )
