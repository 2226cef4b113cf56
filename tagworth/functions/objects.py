"""Objects inside embedded JSON.

Spark can parse a document into a VARIANT but not walk one of unknown depth, so a short
Arrow function lists the objects of each document in reading order.  Only the JSON
texts travel to Python, and all rules about the objects stay in Spark expressions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from .base import any_of, blank_to_null, let, text
from .money import currency_code, parse_price
from .status import availability_norm

_TEXT = T.StringType()
OBJECT_FIELDS = ("type", "name", "price", "currency", "availability", "condition", "country", "keys", "lineage")
OBJECT = T.StructType([T.StructField("seq", T.IntegerType()), *[T.StructField(f, _TEXT) for f in OBJECT_FIELDS]])


def _pick(node: dict, *names: str):
    for name in names:
        value = node.get(name)
        if isinstance(value, dict):
            value = value.get("name") or value.get("@id") or value.get("url")
        if value not in (None, "", [], 0) and not isinstance(value, (dict, list)):
            return value
    return None


def _money(node: dict) -> tuple:
    """(price, currency) an object states: its offer, its price range, then itself."""
    offers = node.get("offers")
    for offer in offers if isinstance(offers, list) else [offers]:
        if isinstance(offer, dict):
            spec = offer.get("priceSpecification")
            for part in (offer, spec if isinstance(spec, dict) else {}):
                price = _pick(part, "price", "value", "lowPrice", "highPrice")
                if price is not None:
                    return price, _pick(part, *fixed.CURRENCY_KEYS) or _pick(offer, *fixed.CURRENCY_KEYS)
    span = node.get("aggregateOffer")
    if isinstance(span, dict) and _pick(span, "lowPrice", "highPrice") is not None:
        return _pick(span, "lowPrice", "highPrice"), _pick(span, *fixed.CURRENCY_KEYS)
    return _pick(node, *fixed.PRICE_KEYS), _pick(node, *fixed.CURRENCY_KEYS)


def _describe(node: dict, lineage: str) -> dict:
    price, currency = _money(node)
    kind = node.get("@type")
    offers = node.get("offers")
    offer = offers[0] if isinstance(offers, list) and offers else offers
    stock = _pick(node, "availability", "availabilityStatus")
    if stock is None and isinstance(offer, dict):
        stock = _pick(offer, "availability", "availabilityStatus")
    found = {
        "type": " ".join(map(str, kind)) if isinstance(kind, list) else kind,
        "name": _pick(node, "name", "title"),
        "price": price,
        "currency": currency,
        "availability": stock,
        "condition": _pick(node, "itemCondition", "condition", "conditionDescription"),
        "country": _pick(node, "addressCountry", "countryOfOrigin"),
        "keys": " ".join(map(str, node)),
        "lineage": lineage,
    }
    return {k: None if v is None else str(v) for k, v in found.items()}


_TOKEN = re.compile(r"\s*([{}\[\],:\"]|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)")
_WORDS = {"true": True, "false": False, "null": None}


def _scalar(token: str):
    if token in _WORDS:
        return _WORDS[token]
    return float(token) if any(c in token for c in ".eE") else int(token)


def parse_deep(doc: str, at: int = 0):
    """The JSON value that begins at ``at``, of any depth: open values wait on a list."""
    open_: list[tuple] = []  # container and the key its next value belongs to
    expect = "value"
    while True:
        m = _TOKEN.match(doc, at)
        if m is None:
            raise ValueError(f"not JSON at {at}")
        token, at = m[1], m.end()
        if expect in ("value", "value or ]"):
            if token in "{[" and len(token) == 1:
                open_.append(({} if token == "{" else [], None))
                expect = "key or }" if token == "{" else "value or ]"
                continue
            if token == "]" and expect == "value or ]":
                value = open_.pop()[0]
            elif token == '"':
                value, at = json.decoder.scanstring(doc, at, False)
            elif token in "}],:":
                raise ValueError(f"a value is missing at {at}")
            else:
                value = _scalar(token)
        elif expect in ("key", "key or }"):
            if token == '"':
                key, at = json.decoder.scanstring(doc, at, False)
                colon = _TOKEN.match(doc, at)
                if colon is None or colon[1] != ":":
                    raise ValueError(f"a colon is missing at {at}")
                at, expect = colon.end(), "value"
                open_[-1] = (open_[-1][0], key)
                continue
            if token != "}" or expect == "key":
                raise ValueError(f"a key is missing at {at}")
            value = open_.pop()[0]
        else:  # after a value
            inside = open_[-1][0]
            if token == ",":
                expect = "key" if isinstance(inside, dict) else "value"
                continue
            if token != ("}" if isinstance(inside, dict) else "]"):
                raise ValueError(f"a comma is missing at {at}")
            value = open_.pop()[0]
        if not open_:
            return value
        inside, key = open_[-1]
        if isinstance(inside, dict):
            inside[key] = value
        else:
            inside.append(value)
        expect = "more"


def _objects(texts) -> list[dict]:
    out: list[dict] = []
    for doc in texts:
        try:
            _walk(doc, out)
        except ValueError:  # broken; see json_problems
            continue
    return out


def _root(doc: str):
    starts = [i for i in (doc.find("{"), doc.find("[")) if i >= 0]
    if not starts:
        raise ValueError("no object or list")
    try:
        return json.JSONDecoder().raw_decode(doc, min(starts))[0]
    except RecursionError:
        return parse_deep(doc, min(starts))


def _walk(doc: str, out: list[dict]) -> None:
    """Append the objects of one JSON text in reading order."""
    root = _root(doc)
    stack = [(root, "")]
    while stack:
        node, lineage = stack.pop()
        if isinstance(node, dict):
            own = [str(node[k]) for k in fixed.IDENTITY_KEYS if isinstance(node.get(k), (str, int))]
            offers = node.get("offers")
            own += [str(o["url"]) for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict) and o.get("url")]
            lineage = " ".join([lineage, *own]).strip()
            out.append({"seq": len(out), **_describe(node, lineage)})
            children = list(node.values())
        else:
            children = node
        stack.extend((c, lineage) for c in reversed(children) if isinstance(c, (dict, list)))


@F.pandas_udf(T.ArrayType(OBJECT))
def json_objects(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else _objects(t))


def _problem(doc: str) -> str | None:
    try:
        _root(doc)
    except ValueError as e:
        return str(e)
    return None


@F.pandas_udf(T.ArrayType(_TEXT))
def json_problems(texts: pd.Series) -> pd.Series:
    """Why JSON texts could not be read, one entry per broken text."""
    return texts.map(lambda t: [] if t is None else [p for p in map(_problem, t) if p is not None])


def state_texts(scripts: Column) -> Column:
    """JSON documents held in inline scripts: bare objects and assigned state objects."""
    names = any_of(fixed.STATE_NAMES)
    assigned = F.transform(
        F.filter(scripts, lambda s: s.rlike(f"{names}\\s*=\\s*\\{{")),
        lambda s: F.regexp_extract(s, f"(?s){names}\\s*=\\s*(\\{{.*)", 1),
    )
    bare = F.filter(scripts, lambda s: F.trim(s).rlike("^[\\[{]"))
    return F.concat(assigned, bare)


def object_price(o: Column) -> Column:
    """``struct(price, currency)`` of an object; currency falls back to USD."""
    number = F.replace(F.trim(text(o["price"])), F.lit(","), F.lit("")).try_cast("double")
    return let(
        F.coalesce(number, parse_price(o["price"])["price"]),
        lambda value: F.when(
            value > 0,
            F.struct(value.alias("price"), F.coalesce(currency_code(o["currency"]), F.lit("USD")).alias("currency")),
        ),
    )


def price_from_objects(objects: Column) -> Column:
    """First price in reading order."""
    with_price = F.filter(objects, lambda o: o["price"].rlike("[1-9]"))
    return F.get(F.filter(F.transform(with_price, object_price), lambda p: p.isNotNull()), F.lit(0))


def is_product(o: Column) -> Column:
    typed = F.lower(text(o["type"])).rlike("product|offer")
    return typed | F.concat(F.lit(" "), text(o["keys"]), F.lit(" ")).rlike(" (?:offers|price|itemCondition|sku|mpn|gtin) ")


def first_value(objects: Column, field: str, test=None) -> Column:
    """First non-empty field in reading order, optionally of objects passing a test."""
    ok = lambda o: (F.trim(text(o[field])) != "") & (F.lit(True) if test is None else test(o))
    return blank_to_null(F.trim(F.get(F.filter(objects, ok), F.lit(0))[field]))


def name_from_objects(objects: Column) -> Column:
    """Name of the first product-like object, else of any object."""
    return F.coalesce(first_value(objects, "name", is_product), first_value(objects, "name"))


def status_from_objects(objects: Column, strict: bool = False) -> Column:
    return availability_norm(first_value(objects, "availability"), strict)


def _carries(o: Column, product_id: Column) -> Column:
    low = F.lower(text(o["lineage"]))
    word = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" "))
    as_word = word.contains(F.concat(F.lit(" "), product_id, F.lit(" ")))
    in_slug = low.contains(F.concat(F.lit("-p"), product_id)) | low.contains(F.concat(F.lit("/p"), product_id))
    return as_word | in_slug


def matched_price(objects: Column, product_id: Column, tie: str = "high", floor: float = 20.0) -> Column:
    """Best price among objects below one that carries the product id.

    Without an id every object may give the price.

    Objects with a final or sale price weigh more; ties take the higher price, or the
    earlier one with ``tie="position"``.
    """
    final = F.lit("(?:finalPrice|salePrice|sellingPrice|currentPrice)")

    def candidate(o: Column) -> Column:
        score = F.when(F.regexp_like(text(o["keys"]), final), 20).otherwise(10) + F.when(
            F.lower(text(o["type"])).contains("product"), 5
        ).otherwise(0)
        return let(
            object_price(o),
            lambda p: F.struct(
                (-score).alias("s"),
                (F.when(F.lit(tie == "high"), -p["price"]).otherwise(o["seq"].cast("double"))).alias("t"),
                p["price"].alias("price"),
                p["currency"].alias("currency"),
            ),
        )

    mine = F.filter(objects, lambda o: (product_id.isNull() | _carries(o, product_id)) & o["price"].rlike("[1-9]"))
    usable = F.filter(F.transform(mine, candidate), lambda c: (c["price"] >= floor) & (c["price"] < fixed.MAX_REASONABLE_PRICE))
    return let(
        F.array_min(usable),
        lambda b: F.when(b.isNotNull(), F.struct(b["price"].alias("price"), b["currency"].alias("currency"))),
    )


def matched_status(objects: Column, product_id: Column) -> Column:
    """Availability of the best matching object; without an id, of any object."""

    def candidate(o: Column) -> Column:
        score = F.when(F.lower(text(o["type"])).contains("product"), 10).otherwise(0) + F.when(_carries(o, product_id), 30).otherwise(0)
        return F.struct((-score).alias("s"), o["seq"].alias("seq"), availability_norm(o["availability"]).alias("status"))

    known = F.filter(objects, lambda o: availability_norm(o["availability"]).isNotNull() & (product_id.isNull() | _carries(o, product_id)))
    return F.array_min(F.transform(known, candidate))["status"]
