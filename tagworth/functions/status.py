"""Status, condition and country words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .base import ColumnOrName, any_of, blank_to_null, first_contained, first_hit, has_any, let, lookup, squeeze, text


def status_norm(c: ColumnOrName) -> Column:
    """Blocked, Sold, Available, Catalog or Unknown; other text is kept as it is.

    Markers match inside words, so "unsold" counts as Sold.
    """

    def resolve(t: Column) -> Column:
        low = F.lower(t)
        return (
            F.when(t == "", F.lit(None).cast("string"))
            .when(has_any(low, fixed.STATUS_BLOCKED), F.lit("Blocked"))
            .when(has_any(low, fixed.STATUS_SOLD), F.lit("Sold"))
            .when(has_any(low, fixed.STATUS_AVAILABLE), F.lit("Available"))
            .when(has_any(low, fixed.STATUS_CATALOG), F.lit("Catalog"))
            .when(low.isin(fixed.STATUS_UNKNOWN), F.lit("Unknown"))
            .otherwise(t)
        )

    return let(F.trim(text(c)), resolve)


def is_status(c: ColumnOrName, name: str) -> Column:
    """True when the text normalises to the given status; null counts as false."""
    return F.coalesce(status_norm(c) == name, F.lit(False))


def listing_is_sold(c: ColumnOrName) -> Column:
    """The page parser's own sold test on a raw status text."""
    return has_any(F.lower(text(c)), fixed.LISTING_SOLD)


def availability_norm(c: ColumnOrName, strict: bool = False) -> Column:
    """schema.org availability.  ``strict`` counts every other value as sold."""
    low = F.lower(text(c))
    other = F.lit("Sold") if strict else F.lit(None).cast("string")
    return (
        F.when(low == "", F.lit(None).cast("string"))
        .when(low.contains("instock") | low.contains("in stock"), F.lit("Available"))
        .when(has_any(low, ["soldout", "sold out", "outofstock"]), F.lit("Sold"))
        .otherwise(other)
    )


def condition_norm(c: ColumnOrName) -> Column:
    """English condition of a Russian, German, English or schema.org value."""

    def resolve(s: Column) -> Column:
        low = F.lower(s)
        noise = F.trim(F.regexp_replace(F.regexp_replace(low, "[^0-9A-Za-zÀ-ÖØ-öø-ÿ ]+", " "), " +", " "))
        key = F.regexp_extract(s, "([^/]*)/*$", 1)
        rest = F.replace(key, F.lit("Condition"), F.lit(""))
        schema = F.coalesce(lookup(key, fixed.CONDITION_SCHEMA), blank_to_null(rest), key)
        words = {**fixed.CONDITION_RU, **fixed.CONDITION_DE, **fixed.CONDITION_EN}
        return (
            F.when(s == "", F.lit(None).cast("string"))
            .when(noise.isin(fixed.CONDITION_NOISE), F.lit(None).cast("string"))
            .when(low.contains("schema.org") & low.contains("condition"), schema)
            .otherwise(F.coalesce(first_contained(low, words), F.substring(s, 1, 60)))
        )

    return let(squeeze(text(c)), resolve)


def looks_like_condition(c: ColumnOrName) -> Column:
    low = F.lower(F.trim(text(c)))
    return ~has_any(low, fixed.CONDITION_BAD_MARKERS) & has_any(low, fixed.CONDITION_GOOD_MARKERS)


def condition_from_text(c: ColumnOrName) -> Column:
    """Condition phrase of a description, else its first short sentence."""

    def resolve(s: Column) -> Column:
        low = F.lower(s)
        first = F.trim(F.regexp_extract(s, "^([^.!?;]*)", 1))
        short = F.when((first != "") & (F.length(first) <= 60) & looks_like_condition(first), first)
        return first_hit([(low.rlike(p), F.lit(v)) for p, v in fixed.CONDITION_PHRASES], short)

    return let(squeeze(text(c)), resolve)


def labeled_condition(c: ColumnOrName) -> Column:
    """Value after "condition:" (or its French, Italian or German word)."""
    letters = "A-Za-zÀ-ÖØ-öø-ÿ"
    label = f"(?iU)\\b(?:{fixed.CONDITION_LABELS})\\b"
    strict = f"{label}\\s*[:\\-]\\s*([{letters}][{letters} /'()\\-]{{1,60}})"
    loose = f"{label}\\s+([{letters}][{letters} /'()\\-]{{1,40}})"

    def resolve(s: Column) -> Column:
        values = [F.trim(F.regexp_extract(s, p, 1)) for p in (strict, loose)]
        return F.coalesce(*[condition_norm(F.regexp_extract(v, "^([^|•·]*)", 1)) for v in values])

    return let(squeeze(text(c)), resolve)


def condition_from_title(c: ColumnOrName) -> Column:
    low = F.lower(text(c))
    return F.when(low.rlike(fixed.TITLE_NEW_PATTERN), F.lit("New")).when(
        low.rlike(fixed.TITLE_USED_PATTERN), F.lit("Used")
    )


def condition_rank(c: ColumnOrName) -> Column:
    """Condition of a letter grade."""
    return lookup(F.upper(F.regexp_replace(text(c), "[^A-Za-z]", "")), fixed.CONDITION_RANKS)


def condition_or_default(c: ColumnOrName, default: str = fixed.DEFAULT_CONDITION) -> Column:
    t = F.trim(text(c))
    return F.when((t == "") | F.lower(t).isin(fixed.CONDITION_EMPTY), F.lit(default)).otherwise(t)


def looks_english(c: ColumnOrName) -> Column:
    """ASCII text whose words are all known condition words."""
    t = text(c)
    words = any_of(fixed.ENGLISH_CONDITION_WORDS)
    only_known = ~t.rlike("[^\\x00-\\x7F]") & F.lower(t).rlike(f"^[^a-z']*(?:{words}(?:[^a-z']+|$))*$")
    return (t == "") | only_known


def country_norm(c: ColumnOrName) -> Column:
    """Last comma part as alias, two-letter code, locale region or capitalised name."""

    def resolve(s: Column) -> Column:
        return (
            F.when(s == "", F.lit(None).cast("string"))
            .when(lookup(F.lower(s), fixed.COUNTRY_ALIASES).isNotNull(), lookup(F.lower(s), fixed.COUNTRY_ALIASES))
            .when(s.rlike("^[A-Za-z]{2}$"), F.upper(s))
            .when(s.rlike("^[a-z]{2}[_-][A-Z]{2}$"), F.substring(s, 4, 2))
            .when(s.rlike("^[A-Za-z .'-]{3,60}$"), F.substring(F.initcap(squeeze(s)), 1, 60))
            .otherwise(F.substring(squeeze(s), 1, 60))
        )

    whole = F.trim(text(c))
    parts = F.filter(F.transform(F.split(whole, ","), lambda p: F.trim(p)), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), whole)
    return let(F.when(whole.contains(","), last).otherwise(whole), resolve)


def ended(end_text: ColumnOrName, now: Column) -> Column:
    """Sold when an ISO end date lies in the past."""
    end = F.try_to_timestamp(text(end_text))
    return F.when(end < now, F.lit("Sold"))
