"""Fields of raw html.

Pages stay one row each; every function reads only the html column.  One linear scan per
page (:mod:`.scan`) gives tags, attributes, nesting and text; calls on the same column share it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, blank_to_null, has_any, let, squeeze, text
from .scan import scan_page, scanner

_ENTITIES = {
    "&nbsp;": " ", "&#160;": " ", "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'",
    "&lt;": "<", "&gt;": ">", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&middot;": "·", "&ndash;": "–",
    "&mdash;": "—", "&euro;": "€", "&#8364;": "€", "&pound;": "£", "&#163;": "£", "&yen;": "¥", "&#165;": "¥",
    "&#36;": "$", "&dollar;": "$", "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ccedil;": "ç",
    "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&szlig;": "ß", "&amp;": "&",
}


def unescape(c: Column) -> Column:
    """Common entities as characters."""
    pairs = ", ".join(f'struct("{k}" AS e, {"chr(34)" if v == chr(34) else chr(34) + v + chr(34)} AS c)' for k, v in _ENTITIES.items())
    out = F.aggregate(F.expr(f"array({pairs})"), c, lambda acc, p: F.replace(acc, p["e"], p["c"]))
    return F.when(c.contains("&"), out).otherwise(c)


def text_of(fragment: Column) -> Column:
    """Squeezed text of an html fragment."""
    return squeeze(unescape(F.regexp_replace(fragment, "<[^<>]*>", " ")))


def page(html: ColumnOrName) -> Column:
    """The scanned page; the functions below take html or what this gives."""
    return scan_page(text(html))


def pick(html: ColumnOrName, *selectors: str) -> Column:
    """Map of selectors (see :mod:`.scan`) to the text of their first element; others are absent."""
    return scanner({}, list(selectors))(text(html), F.lit(None).cast("string"))["picked"]


def _page(html: ColumnOrName, scanned: Column | None) -> Column:
    return page(html) if scanned is None else scanned


def shown_text(html: ColumnOrName = "html", scanned: Column | None = None) -> Column:
    """Visible text of a page, squeezed."""
    return F.array_join(_page(html, scanned)["lines"], " ")


def visible_text(html: ColumnOrName = "html", scanned: Column | None = None) -> Column:
    """Lower-case visible text of a page."""
    return F.lower(shown_text(html, scanned))


def page_title(html: ColumnOrName = "html", scanned: Column | None = None) -> Column:
    return blank_to_null(_page(html, scanned)["title"])


def heading(html: ColumnOrName = "html", level: int = 1, scanned: Column | None = None) -> Column:
    """Text of the first heading of a level from 1 to 3."""
    return blank_to_null(_page(html, scanned)[f"h{level}"])


def links(html: ColumnOrName = "html", scanned: Column | None = None) -> Column:
    return _page(html, scanned)["links"]


def text_lines(html: ColumnOrName = "html", limit: int | None = None, scanned: Column | None = None) -> Column:
    """Text nodes in order, empty ones dropped; ``limit`` drops longer ones."""
    lines = _page(html, scanned)["lines"]
    return lines if limit is None else F.filter(lines, lambda t: F.length(t) <= limit)


def meta_entries(html: ColumnOrName = "html", scanned: Column | None = None) -> Column:
    """``<meta>`` tags with a content as array of (key, content), in page order."""
    return _page(html, scanned)["metas"]


def meta_get(entries: Column, *keys: str) -> Column:
    """Content of the first key, in the given order, that the page has."""
    one = lambda k: F.get(F.filter(entries, lambda e: e["key"] == k.lower()), F.lit(0))["content"]
    return F.coalesce(*[one(k) for k in keys])


def meta_values(html: ColumnOrName) -> Column:
    """Map of meta keys to contents, first occurrence wins."""

    def build(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))

    return let(meta_entries(html), build)


def label_pairs(html: ColumnOrName = "html", scanned: Column | None = None) -> Column:
    """(label, value) pairs of dt/dd and th/td neighbours; labels in lower case.

    Text of a table inside a cell belongs to the cells of that table.
    """
    return let(_page(html, scanned), lambda p: F.concat(p["terms"], p["cells"]))


def label_value(pairs: Column, labels: list[str]) -> Column:
    hit = F.filter(pairs, lambda p: has_any(p["label"], labels) & (p["value"] != ""))
    return F.get(hit, F.lit(0))["value"]


def scripts(html: ColumnOrName = "html", scanned: Column | None = None) -> Column:
    """Bodies of inline scripts."""
    return _page(html, scanned)["scripts"]


def jsonld_texts(html: ColumnOrName = "html", scanned: Column | None = None) -> Column:
    """JSON-LD bodies without comment and CDATA wrappers."""
    clean = lambda t: F.trim(
        F.regexp_replace(
            F.trim(F.regexp_replace(F.trim(t), "^<!--|-->$", "")), "^(?://)?<!\\[CDATA\\[|(?://)?\\]\\]>$", ""
        )
    )
    return F.filter(F.transform(_page(html, scanned)["jsonld"], clean), lambda t: t != "")


def jsonld_blocks(html: ColumnOrName = "html") -> Column:
    """Parsed JSON-LD blocks; a block with stray text around it is cut at its brackets."""

    def parse(t: Column) -> Column:
        inner = F.when(t.rlike("^[^{]*\\["), F.regexp_extract(t, "(?s)(\\[.*\\])", 1)).otherwise(
            F.regexp_extract(t, "(?s)(\\{.*\\})", 1)
        )
        return F.coalesce(F.try_parse_json(t), F.try_parse_json(inner))

    return F.filter(F.transform(jsonld_texts(html), parse), lambda v: v.isNotNull())


def site_hint(html: ColumnOrName = "html") -> Column:
    """Lower-case text of canonical link, og:url, site name and card domain."""

    def build(p: Column) -> Column:
        m = p["metas"]
        return F.lower(F.concat_ws(" ", p["canonical"], meta_get(m, "og:url"), meta_get(m, "og:site_name"), meta_get(m, "twitter:domain")))

    return let(page(html), build)


def canonical_url(html: ColumnOrName = "html", scanned: Column | None = None) -> Column:
    return let(_page(html, scanned), lambda p: F.coalesce(p["canonical"], meta_get(p["metas"], "og:url")))


def redirect_url(html: ColumnOrName) -> Column:
    """Target of a client-side redirect."""
    return blank_to_null(F.trim(F.regexp_extract(text(html), "(?i)window\\.location\\.replace\\([\"']([^\"']+)[\"']\\)", 1)))


def match_spans(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches as (position from 1, whole match, group value)."""

    def build(t: Column) -> Column:
        whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        gaps = F.split(t, pattern)
        zipped = F.arrays_zip(whole.alias("whole"), value.alias("value"), gaps.alias("gap"))
        start = F.struct(
            F.lit(1).alias("at"), F.expr("array()").cast("array<struct<pos:int,whole:string,value:string>>").alias("out")
        )

        def step(acc: Column, m: Column) -> Column:
            at = acc["at"] + F.length(m["gap"])
            return F.struct(
                (at + F.length(m["whole"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(at.alias("pos"), m["whole"].alias("whole"), m["value"].alias("value")))).alias("out"),
            )

        return F.aggregate(F.filter(zipped, lambda m: m["whole"].isNotNull()), start, step, lambda acc: acc["out"])

    return let(c, build)


def around(c: Column, span: Column, before: int, after: int) -> Column:
    """Text around a match."""
    start = F.greatest(F.lit(1), span["pos"] - before)
    end = span["pos"] + F.length(span["whole"]) + after
    return F.substring(c, start, end - start)
