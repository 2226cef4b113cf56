"""Line neighbourhoods within one page.

A page's lines are an array in its own row, so these need neither an explode nor a
shuffle, and a page with many lines does not burden any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..functions.base import has_any, let
from ..functions.money import parse_price


def _index_of(lines: Column, test) -> Column:
    """0-based index of the first line passing the test, -1 without one."""
    flags = F.transform(lines, lambda line: test(F.lower(line)))
    return F.array_position(flags, True) - 1


def near_anchor(lines: Column, anchor: str = "add to bag", before: int = 40, after: int = 20, default: int = 120) -> Column:
    """Lines from ``before`` lines ahead of the anchor line to ``after - 1`` behind it."""

    def cut(i: Column) -> Column:
        at = F.when(i >= 0, i).otherwise(F.least(F.size(lines) - 1, F.lit(default))).cast("int")
        start = F.greatest(F.lit(0), at - before)
        end = F.least(F.size(lines), at + after)
        return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))

    return F.when(F.size(lines) > 0, let(_index_of(lines, lambda t: t.contains(anchor)), cut)).otherwise(lines)


def before_marker(lines: Column, markers: list[str] = fixed.STOP_MARKERS) -> Column:
    """Lines ahead of the first one that holds a stop marker."""

    def cut(i: Column) -> Column:
        return F.when(i >= 0, F.slice(lines, 1, i.cast("int"))).otherwise(lines)

    return let(_index_of(lines, lambda t: has_any(t, markers)), cut)


def _first_price(prices: Column) -> Column:
    return F.get(F.filter(prices, lambda p: p["price"] > 0), F.lit(0))


def label_next_line(lines: Column) -> Column:
    """Price on the line that follows a "price" label line."""

    def head(i: Column) -> Column:
        low = F.regexp_replace(F.lower(F.trim(F.get(lines, i))), "[^a-z\\s]", "")
        return low.contains("price") & ~has_any(low, ["price was", "est retail"])

    last = F.size(lines) - 2
    heads = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: head(i))
    return F.when(last >= 0, _first_price(F.transform(heads, lambda i: parse_price(F.get(lines, i + 1)))))


def scored_best(cands: Column, tie: str = "low") -> Column:
    """Best of an array of ``(score, pos, price, currency)``: score, then price or position."""
    key = {"low": lambda c: c["price"], "high": lambda c: -c["price"], "position": lambda c: c["pos"].cast("double")}[tie]
    keyed = F.transform(cands, lambda c: F.struct((-c["score"]).alias("s"), key(c).alias("t"), c["pos"].alias("pos"), c["price"].alias("price"), c["currency"].alias("currency")))
    return let(F.array_min(keyed), lambda b: F.when(b.isNotNull(), F.struct(b["price"].alias("price"), b["currency"].alias("currency"))))


def anchor_price(lines: Column, anchor: str = "add to bag") -> Column:
    """Most telling price near the anchor: labelled lines first, then the lowest."""

    def candidate(line: Column, i: Column) -> Column:
        low = F.lower(line)
        score = (
            F.when(low.contains("price:"), 10).when(low.contains("price"), 6).otherwise(0)
            + F.when(has_any(low, ["now", "current", "sale"]), 3).otherwise(0)
            + F.when(F.trim(line).startswith("$"), 2).otherwise(0)
        )
        return let(
            parse_price(line),
            lambda p: F.struct(
                score.alias("score"), i.alias("pos"), p["price"].alias("price"), F.coalesce(p["currency"], F.lit("USD")).alias("currency")
            ),
        )

    near = F.filter(near_anchor(lines, anchor), lambda t: ~has_any(F.lower(t), fixed.PROMO_PRICE_TOKENS) & t.rlike("[0-9]"))
    return scored_best(F.filter(F.transform(near, candidate), lambda c: c["price"] > 0))


def labeled_price(lines: Column) -> Column:
    """Earliest "price:" line before the stop markers, else the value below a label."""

    def candidate(line: Column, i: Column) -> Column:
        score = F.when(F.lower(F.trim(line)).startswith("- price:"), 20).otherwise(12)
        return let(
            parse_price(line),
            lambda p: F.struct(
                score.alias("score"), i.alias("pos"), p["price"].alias("price"), F.coalesce(p["currency"], F.lit("USD")).alias("currency")
            ),
        )

    own = before_marker(lines)
    usable = lambda t: F.lower(t).contains("price:") & ~has_any(F.lower(t), ["price was", "est. retail"])
    direct = scored_best(F.filter(F.transform(F.filter(own, usable), candidate), lambda c: c["price"] > 0), "position")
    return F.coalesce(direct, label_next_line(own))
