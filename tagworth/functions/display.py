"""Report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .base import ColumnOrName, col, has_any, text


def money_text(amount: ColumnOrName, currency: ColumnOrName) -> Column:
    """Amount cut to whole units with its currency, "N/A" without an amount."""
    whole = F.when(col(amount) >= 0, F.floor(col(amount))).otherwise(F.ceil(col(amount))).cast("long").cast("string")
    cur = F.trim(text(currency))
    return F.when(whole.isNull(), F.lit("N/A")).when(cur == "", whole).otherwise(F.concat_ws(" ", whole, cur))


def percent_text(share: ColumnOrName) -> Column:
    shown = F.format_string("%.1f%%", col(share).cast("double") * 100)
    return F.when(col(share).isNull(), F.lit("N/A")).otherwise(shown)


def escape_html(c: ColumnOrName, quote: bool = False) -> Column:
    """Markup characters as entities; ``quote`` also covers both quote characters."""
    out = text(c)
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quote:
        pairs += [('"', "&quot;"), ("'", "&#x27;")]
    for raw, entity in pairs:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def status_badge(status: ColumnOrName, price: ColumnOrName) -> Column:
    return (
        F.when(col(price).isNull(), F.lit("No price"))
        .when(has_any(F.lower(F.trim(text(status))), fixed.BADGE_SOLD), F.lit("Sold"))
        .otherwise(F.lit("Available"))
    )


def run_stamp(ts: ColumnOrName) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd_HH-mm-ss")


def content_hash(content: ColumnOrName) -> Column:
    """SHA-256 of a binary column, the cache key of an image."""
    return F.sha2(col(content), 256)


def reason_text(
    code: ColumnOrName,
    similarity: ColumnOrName,
    color: ColumnOrName,
    distance: ColumnOrName,
    final: ColumnOrName,
    min_similarity: float = 0.85,
    min_color: float = 0.65,
    max_distance: int = 12,
) -> Column:
    """Readable reason of a visual or routing rejection."""
    sim = col(similarity).cast("double") * 100
    fin = F.coalesce(col(final).cast("double") * 100, sim)
    shown_color = F.when(col(color).isNull(), F.lit("n/a")).otherwise(F.format_string("%.1f%%", col(color).cast("double") * 100))
    shown_distance = F.coalesce(col(distance).cast("string"), F.lit("n/a"))
    t = fixed.REASON_TEXT
    c = col(code)
    limit = F.lit(min_similarity * 100)
    out = (
        F.when(c == "clip_below_threshold", F.format_string(t["clip_below_threshold"], fin, sim, limit))
        .when(c == "phash_penalty_final_below", F.format_string(t["phash_penalty_final_below"], fin, sim, shown_distance, limit))
        .when(c == "color_mismatch", F.format_string(t["color_mismatch"], shown_color, F.lit(min_color * 100)))
        .when(c == "phash_mismatch", F.format_string(t["phash_mismatch"], shown_distance, F.lit(max_distance)))
    )
    for plain in ("catalog_page", "unsupported_domain", "shape_gate_mismatch", "brand_gate_mismatch", "sold_item"):
        out = out.when(c == plain, F.lit(t[plain]))
    return out.otherwise(F.format_string(fixed.OTHER_REASON_TEXT, c))
