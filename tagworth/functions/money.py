"""Price text, currency codes and price plausibility.

Symbols are matched longest first, so ``HK$ 500`` is Hong Kong dollars.  Matching the
bare ``$`` first would read every regional dollar as USD.  Non-breaking spaces count
as thousands separators.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .base import WIDE_SPACE, ColumnOrName, any_of, blank_to_null, has_any, let, lookup, text

_SEP = "[.,\\s\\u00a0\\u202f]"
_NUMBER = f"[0-9]{{1,3}}(?:{_SEP}[0-9]{{3}})+(?:[.,][0-9]{{2}})?|[0-9]+(?:[.,][0-9]{{2}})?"
_GAP = "[\\s\\u00a0\\u202f]*"
# letter-plus-dollar symbols must not sit inside a word: "BAGS$500" is in dollars
_SYMBOL = (
    "EUROS?|(?:US|CA|AU|MX|NT|HK)\\s?\\$|(?:CN|JP)\\s*¥|GB\\s*£|(?<![A-Z])[ACRS]\\$|"
    "USD|EUR|GBP|JPY|RUB|RUR|CAD|AUD|CHF|CNY|RMB|INR|KRW|MXN|BRL|ZAR|TWD|HKD|SGD|[$€£¥₽₹₩]"
)
# both run on upper-case text, which is much cheaper than ignoring case
_SYMBOL_FIRST = f"(?:{_SYMBOL}){_GAP}(?:{_NUMBER})"
_NUMBER_FIRST = f"(?:{_NUMBER}){_GAP}(?:{_SYMBOL})"
_ROUBLE = "(?iU)\\bруб(?:\\.|ля|лей|ль)?\\b"
_DOLLAR_WORD = "(?iU)\\bдол(?:л(?:ар(?:ов|а)?)?)?\\.?\\b"

PRICE_TYPE = "struct<price:double,currency:string>"


def _by_length(symbols) -> list[str]:
    return sorted(symbols, key=lambda s: (-len(s), s))


def _long_symbols() -> list[str]:
    return [s for s in _by_length(fixed.CURRENCY_ALIASES) if len(s) > 1]


def _roubles(c: Column) -> Column:
    return F.when(c.rlike("(?iu)руб"), F.regexp_replace(c, _ROUBLE, "RUB")).otherwise(c)


def currency_words(c: ColumnOrName) -> Column:
    """Local words for rouble and dollar become codes; null becomes empty text."""
    t = F.trim(F.replace(text(c), F.lit("\u00a0"), F.lit(" ")))
    return F.trim(F.regexp_replace(_roubles(t), _DOLLAR_WORD, "USD"))


def currency_code(c: ColumnOrName) -> Column:
    """Three-letter code of a symbol, alias or code; null when nothing matches."""

    def resolve(raw: Column) -> Column:
        upper = F.upper(raw)
        compact = F.replace(upper, F.lit(" "), F.lit(""))
        contained = lookup(F.regexp_extract(upper, any_of(_long_symbols()), 0), fixed.CURRENCY_ALIASES)
        return F.when(
            raw != "",
            F.coalesce(
                lookup(upper, fixed.CURRENCY_ALIASES),
                lookup(compact, fixed.CURRENCY_ALIASES),
                F.when(compact.rlike("^[A-Z]{3}$"), compact),
                contained,
            ),
        )

    return let(_roubles(F.trim(text(c))), resolve)


def _symbol_code(symbol: Column) -> Column:
    compact = F.regexp_replace(symbol, WIDE_SPACE, "")
    return lookup(compact, {k.replace(" ", ""): v for k, v in fixed.CURRENCY_ALIASES.items()})


def _mentioned_currency(t: Column) -> Column:
    """Currency of the first symbol or code anywhere in the text."""
    pattern = any_of(s for s in _by_length(fixed.CURRENCY_ALIASES) if s != "R") + "|(?<![A-Z0-9])R(?![A-Z0-9])"
    return lookup(F.regexp_extract(t, pattern, 0), fixed.CURRENCY_ALIASES)


def number_value(number: Column) -> Column:
    """Digits with European or American separators as a double, null if malformed."""

    def value(n: Column) -> Column:
        return (
            F.when(n.rlike(",[0-9]{2}$"), F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(n.contains(","), F.replace(n, F.lit(","), F.lit("")))
            .when(n.rlike("^[^.]*\\.[0-9]{2}$"), n)
            .otherwise(F.replace(n, F.lit("."), F.lit("")))
            .try_cast("double")
        )

    return let(F.regexp_replace(number, "[\\s\\u00a0\\u202f]", ""), value)  # an empty text gives null


def parse_price(c: ColumnOrName) -> Column:
    """``struct(price, currency)`` of free text.

    Symbol before number, else number before symbol, else a bare number when a currency
    is mentioned anywhere.  The currency is kept when no price is found.
    """

    def first(t: Column) -> Column:
        return let(F.struct(t.alias("t"), F.regexp_extract(t, _SYMBOL_FIRST, 0).alias("m1")), second)

    def second(a: Column) -> Column:
        v1 = number_value(F.regexp_extract(a["m1"], f"({_NUMBER})$", 1))
        return let(F.struct(a["t"].alias("t"), a["m1"].alias("m1"), v1.alias("v1")), third)

    def third(a: Column) -> Column:
        m2 = F.when(a["v1"].isNull(), F.regexp_extract(a["t"], _NUMBER_FIRST, 0)).otherwise(F.lit(""))
        return let(F.struct(a["t"].alias("t"), a["m1"].alias("m1"), a["v1"].alias("v1"), m2.alias("m2")), last)

    def last(a: Column) -> Column:
        v2 = number_value(F.regexp_extract(a["m2"], f"^({_NUMBER})", 1))
        v3 = number_value(F.regexp_extract(a["t"], f"({_NUMBER})", 1))
        currency = (
            F.when(a["m2"] != "", _symbol_code(F.regexp_extract(a["m2"], "([^0-9]*)$", 1)))
            .when(a["m1"] != "", _symbol_code(F.regexp_extract(a["m1"], "^([^0-9]*)", 1)))
            .otherwise(_mentioned_currency(a["t"]))
        )

        def finish(cur: Column) -> Column:
            price = let(F.coalesce(a["v1"], v2, F.when(cur.isNotNull(), v3)), lambda p: F.when(p > 0, p))
            return F.struct(price.alias("price"), cur.alias("currency"))

        return let(currency, finish)

    return let(F.upper(_roubles(F.trim(text(c)))), first)


def parse_sold_price(c: ColumnOrName) -> Column:
    """Price of a "sold for ..." text, up to 100000; currency falls back to USD."""
    number = "([0-9\\s,.]+)"
    sign = "[$€£¥]?"
    patterns = [
        f"(?i)sold\\s+(?:at|for)\\s*{sign}\\s*{number}",
        f"(?i)sold\\s+{sign}\\s*{number}",
        f"(?i){number}\\s*{sign}\\s+sold",
        f"(?i)sold\\s+price[:\\s]+{sign}\\s*{number}",
        f"(?i)final\\s+price[:\\s]+{sign}\\s*{number}",
    ]

    def resolve(t: Column) -> Column:
        amounts = [
            number_value(F.regexp_extract(F.regexp_extract(t, p, 1), f"({_NUMBER})", 1))
            for p in patterns
        ]
        fallback = F.coalesce(*[let(a, lambda v: F.when((v > 0) & (v <= 100000), v)) for a in amounts])

        def pick(direct: Column) -> Column:
            def named(price: Column) -> Column:
                currency = F.coalesce(direct["currency"], F.lit("USD"))
                return F.struct(price.alias("price"), F.when(price.isNotNull(), currency).alias("currency"))

            return let(F.coalesce(direct["price"], fallback), named)

        return let(parse_price(t), pick)

    return let(text(c), resolve)


def parse_price_lenient(c: ColumnOrName) -> Column:
    """Like :func:`parse_price`, then any number for texts with odd currency glyphs."""

    def resolve(t: Column) -> Column:
        low = F.lower(t)
        currency = (
            F.when(t.contains("€") | low.contains("eur"), F.lit("EUR"))
            .when(t.contains("$") | low.contains("usd"), F.lit("USD"))
            .when(t.contains("£") | low.contains("gbp"), F.lit("GBP"))
        )
        n = F.regexp_replace(F.regexp_extract(t, "[0-9][0-9\\s\\u00a0.,]*", 0), "[\\s\\u00a0]", "")
        comma, dot = n.contains(","), n.contains(".")
        decimal_comma = (comma & dot & n.rlike(",[^.]*$")) | (comma & ~dot & n.rlike(",[^,]{2}$"))
        value = (
            F.when(decimal_comma, F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(comma, F.replace(n, F.lit(","), F.lit("")))
            .otherwise(n)
        ).try_cast("double")

        def pick(direct: Column) -> Column:
            good = direct["price"].isNotNull()
            return F.struct(
                F.when(good, direct["price"]).otherwise(F.when(value > 0, value)).alias("price"),
                F.when(good, direct["currency"]).otherwise(currency).alias("currency"),
            )

        return let(parse_price(t), pick)

    return let(text(c), resolve)


def price_in_limits(p: Column, max_price: dict[str, float] = fixed.MAX_PRICE, min_price: dict[str, float] = fixed.MIN_PRICE) -> Column:
    """Whether a parsed price is absent or lies between the limits of its currency."""
    high = F.coalesce(lookup(p["currency"], max_price), F.lit(fixed.DEFAULT_MAX_PRICE))
    low = F.coalesce(lookup(p["currency"], min_price), F.lit(fixed.DEFAULT_MIN_PRICE))
    return p["price"].isNull() | ((p["price"] <= high) & (p["price"] >= low))


def is_valid_price_text(
    c: ColumnOrName,
    context: ColumnOrName | None = None,
    stop_words: list[str] = fixed.PRICE_STOP_WORDS,
    max_price: dict[str, float] = fixed.MAX_PRICE,
    min_price: dict[str, float] = fixed.MIN_PRICE,
) -> Column:
    """False for shipping, instalment or discount texts and for implausible amounts."""
    t = text(c)
    around = F.lit("") if context is None else text(context)
    words = F.lower(F.concat_ws(" ", t, around))
    return (t != "") & ~has_any(words, stop_words) & let(parse_price(t), lambda p: price_in_limits(p, max_price, min_price))


def valid_price(c: ColumnOrName) -> Column:
    """:func:`parse_price` of a text that passes :func:`is_valid_price_text`, else null."""
    t = text(c)
    good = lambda p: F.when(p["price"].isNotNull() & price_in_limits(p), p)
    return F.when((t != "") & ~has_any(F.lower(t), fixed.PRICE_STOP_WORDS), let(parse_price(t), good))


def highest_price(currency: Column, max_price: dict[str, float] = fixed.MAX_PRICE) -> Column:
    """The highest plausible amount in a currency; more than the default for small units."""
    return F.greatest(lookup(currency, max_price), F.lit(fixed.DEFAULT_MAX_PRICE))


def plausible_price(price: Column, currency: Column | None = None) -> Column:
    """Plausibility of a bare number; the upper limit rises with the currency, if given."""
    high = F.lit(fixed.DEFAULT_MAX_PRICE) if currency is None else highest_price(currency)
    return (price >= fixed.DEFAULT_MIN_PRICE) & (price <= high)


def asking_price(amount: ColumnOrName, currency: ColumnOrName, default: str = "RUB") -> Column:
    """The user's own asking price: ``struct(price, currency, error)``.

    A bare amount takes the hinted currency, else ``default``.  The USD value comes from
    joining the result with the rates.
    """

    def resolve(v: Column) -> Column:
        hint = v["hint"]
        retry = parse_price(F.concat_ws(" ", F.coalesce(hint, F.lit(default)), v["amount"]))

        def pick(p: Column) -> Column:
            asked = (v["amount"] != "") | v["has_currency"]
            code = F.coalesce(currency_code(F.coalesce(p["currency"], hint)), F.lit(default))
            return F.struct(
                F.round(p["price"], 2).alias("price"),
                F.when(p["price"].isNotNull(), code).alias("currency"),
                F.when(asked & p["price"].isNull(), F.lit(fixed.ASKING_PRICE_ERROR)).alias("error"),
            )

        found = let(parse_price(v["amount"]), lambda direct: F.when(direct["price"].isNotNull(), direct).otherwise(retry))
        return let(found, pick)

    parts = F.struct(
        currency_words(amount).alias("amount"),
        currency_code(currency_words(currency)).alias("hint"),
        (text(currency) != "").alias("has_currency"),
    )
    return let(parts, resolve)


def price_symbols() -> list[str]:
    """All known symbols and codes, longest first."""
    return [re.sub(r"\s", "", s) for s in _by_length(fixed.CURRENCY_ALIASES)]
