"""Title, brand and broken-text functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from .base import ColumnOrName, first_contained, has_any, let, squeeze, text


def brand_token(c: ColumnOrName) -> Column:
    """Lower case, everything but letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding to ASCII, derived from Unicode data.

    One-letter results go into a ``translate`` pair, longer ones (ligatures, fractions,
    trade-mark signs) into a replacement table.
    """
    source, target, long = [], [], {}
    for cp in [*range(0xA0, 0x0250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        folded = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(chr(cp))
            target.append(folded)
        elif len(folded) > 1:
            long[chr(cp)] = folded
    return "".join(source), "".join(target), long


_FOLD_FROM, _FOLD_TO, _FOLD_LONG = _fold_tables()


def fold_ascii(c: Column) -> Column:
    """Drop diacritics and every remaining non-ASCII character."""
    table = F.expr("array(" + ", ".join(f"struct('{ch}' AS ch, '{out}' AS out)" for ch, out in _FOLD_LONG.items()) + ")")
    long = F.aggregate(table, c, lambda acc, e: F.replace(acc, e["ch"], e["out"]))
    # a class of so many letters is slow to try at every place of a text, a look-up is not
    held = F.char_length(F.translate(c, "".join(_FOLD_LONG), "")) < F.char_length(c)
    folded = F.regexp_replace(F.translate(F.when(held, long).otherwise(c), _FOLD_FROM, _FOLD_TO), "[^\\x00-\\x7F]", "")
    return F.when(c.rlike("[^\\x00-\\x7F]"), folded).otherwise(c)


def brand_token_ascii(c: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold_ascii(text(c))), "[^a-z0-9]+", " "))


def brand_aliases() -> list[tuple[str, str]]:
    """(alias, brand) pairs, longest alias first."""
    pairs: dict[str, str] = {}
    for slug in fixed.BRAND_SLUGS:
        spaced = slug.replace("-", " ")
        pairs[spaced] = spaced
        pairs[spaced.replace(" ", "")] = spaced
    pairs.update(fixed.BRAND_ALIASES)
    return sorted(pairs.items(), key=lambda kv: (-len(kv[0]), kv[0]))


def _brand_in(token: Column) -> Column:
    padded = F.concat(F.lit(" "), token, F.lit(" "))
    return first_contained(padded, {f" {alias} ": brand for alias, brand in brand_aliases()})


def brand_of(title: ColumnOrName, url: ColumnOrName | None = None) -> Column:
    """Known brand in the title, else in the url; the longest alias wins."""
    found = let(brand_token(title), _brand_in)
    return found if url is None else F.coalesce(found, let(brand_token(url), _brand_in))


def has_brand(title: ColumnOrName, url: ColumnOrName, brand: ColumnOrName) -> Column:
    """The brand occurs in title or url; true when no brand is wanted."""
    b = brand_token_ascii(brand)
    return (b == "") | brand_token_ascii(title).contains(b) | brand_token_ascii(url).contains(b)


def title_tokens(c: ColumnOrName, stop_words: list[str] = fixed.TITLE_STOP_WORDS) -> Column:
    """Words of three and more characters without stop words, duplicates kept."""
    words = F.split(F.lower(fold_ascii(text(c))), "[^a-z0-9]+")  # an empty word at either end is too short to stay
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(stop_words))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of ``n`` tokens; empty when there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
    return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


def name_keywords(name: ColumnOrName, limit: int, stop_words: list[str] = fixed.TITLE_STOP_WORDS) -> Column:
    """Distinct 3-word phrases, 2-word phrases, then single words, at most ``limit``."""

    def build(parts: Column) -> Column:
        singles = F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(stop_words))
        phrases = F.filter(F.concat(ngrams(parts, 3), ngrams(parts, 2)), lambda p: F.length(p) >= 3)
        return F.slice(F.array_distinct(F.concat(phrases, singles)), 1, limit)

    parts = F.filter(F.split(brand_token_ascii(name), " "), lambda w: w != "")
    return let(parts, build)


def keyword_list(raw: Column, limit: int, stop_words: list[str] = fixed.TITLE_STOP_WORDS) -> Column:
    """Normalised distinct keywords of an array of texts, at most ``limit``."""
    cleaned = F.transform(raw, lambda x: brand_token_ascii(x))
    kept = F.filter(cleaned, lambda w: (F.length(w) >= 3) & ~w.isin(stop_words))
    return F.slice(F.array_distinct(F.coalesce(kept, F.array().cast("array<string>"))), 1, limit)


def clean_text(c: ColumnOrName, limit: int = 240) -> Column:
    """Squeezed text, cut to ``limit`` characters with an ellipsis."""

    def cut(t: Column) -> Column:
        return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)

    return let(squeeze(text(c)), cut)


def clean_title(c: ColumnOrName, site: str) -> Column:
    """Title without the site suffix; generic, promo and block-page titles become null."""
    none = F.lit(None).cast("string")

    def ebay(t: Column) -> Column:
        s = F.trim(F.regexp_replace(t, "(?i)\\s*[|–—-]\\s*ebay\\s*$", ""))
        low = F.lower(s)
        bad = (
            (s == "")
            | has_any(low, fixed.EBAY_BAD_TITLE_MARKERS)
            | low.isin(fixed.EBAY_GENERIC_TITLES)
            | low.startswith("ebay |")
            | low.startswith("home |")
            | low.startswith("category:")
        )
        return F.when(bad, none).otherwise(s)

    def realreal(t: Column) -> Column:
        low = F.lower(t)
        left = F.trim(F.substring_index(t, "|", 1))
        usable = (left != "") & ~F.lower(left).isin(fixed.REALREAL_GENERIC_TITLES)
        out = F.when(t.contains("|") & usable, left).otherwise(t)
        bad = low.isin(fixed.REALREAL_GENERIC_TITLES) | has_any(low, fixed.REALREAL_PROMO_MARKERS)
        return F.when(bad | (F.length(out) < 5), none).otherwise(out)

    def poshmark(t: Column) -> Column:
        low = F.lower(t)
        bad = low.isin(["", *fixed.POSHMARK_GENERIC_TITLES]) | low.startswith("home |") | low.startswith("home -")
        return F.when(bad, none).otherwise(t)

    rule = {"ebay": ebay, "therealreal": realreal, "poshmark": poshmark}[site]
    return let(squeeze(text(c)), rule)


def strip_markers(c: ColumnOrName) -> Column:
    """Remove emoji and arrow markers."""
    return F.regexp_replace(text(c), "[" + fixed.DISPLAY_MARKERS + "]", "")


_BAD_CLASS = "[" + fixed.MOJIBAKE_CHARS + "]"


def mojibake_score(c: ColumnOrName) -> Column:
    """Weighted count of characters typical of text decoded with the wrong code page."""
    t = text(c)
    return (
        F.regexp_count(t, F.lit(fixed.MOJIBAKE_PATTERN)) * 2
        + F.regexp_count(t, F.lit(_BAD_CLASS)) * 3
        + F.regexp_count(t, F.lit("[РС]" + _BAD_CLASS)) * 4
        + F.regexp_count(t, F.lit("�")) * 6
    )


_CODE_PAGES = ("cp1251", "cp866", "latin1")


def _redecoded(value: str) -> list[str | None]:
    out: list[str | None] = []
    for page in _CODE_PAGES:
        try:
            out.append(value.encode(page).decode("utf-8"))
        except (UnicodeEncodeError, UnicodeDecodeError):
            out.append(None)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _redecode(values: pd.Series) -> pd.Series:
    return values.map(_redecoded, na_action="ignore")


def repair_mojibake(c: ColumnOrName) -> Column:
    """The re-decoding with the lowest score, the text itself on ties.

    Spark's ``encode`` refuses cp1251 and cp866, so the re-decodings come from one Arrow
    function.  It sees only suspicious texts; the choice stays in Spark.
    """
    t = text(c)
    suspicious = t.rlike(_BAD_CLASS) | t.rlike(fixed.MOJIBAKE_PATTERN) | t.contains("\ufffd")
    again = _redecode(F.when(suspicious, t))
    options = [t, *[F.get(again, F.lit(i)) for i in range(len(_CODE_PAGES))]]
    scored = F.array(
        *[F.struct(mojibake_score(o).alias("score"), F.lit(i).alias("rank"), o.alias("text")) for i, o in enumerate(options)]
    )
    return F.array_min(F.filter(scored, lambda s: s["text"].isNotNull()))["text"]
