"""One linear pass over the html of a page: tags, attributes, text and nesting.

The scanner reads a page from left to right once.  Every search starts where the last one
ended, so broken pages (comments, scripts, quotes or elements that are never closed) cost
what sound pages cost.  A batch of pages is one Arrow call; the rules about what it
finds stay in Spark expressions.

Selectors: ``tag``, ``.name`` (class contains), ``#id`` (equal), ``[attr=value]`` (contains, an
empty value means present), each with an optional tag in front; ``outer inner`` for an
element inside another; then optionally ``@attr`` (its value instead of the text),
``@~ pattern`` (the tag as written must match) and ``~ pattern`` (a text inside must match).
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "noscript", "template"))
# Elements that close an open one of their kind, up to the nearest list or table.
_KIND = {"td": "cell", "th": "cell", "tr": "row", "li": "item", "option": "option", "dt": "term", "dd": "term", "p": "p", "a": "a", "button": "button"}
_SCOPES = frozenset(("table", "ul", "ol", "dl", "select"))
_HEADINGS = ("h1", "h2", "h3")
_NOTED = frozenset(("meta", "a", "link"))
_TELLING = frozenset("h1 h2 h3 button a span div p".split())
_TELLING_WORDS = re.compile("price|status|stock|condition|availability", re.I)

_MARK = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_EDGE = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile("[ \t\n\x0b\f\r  ]+")
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_RAW, "title")}

_text, _texts = T.StringType(), T.ArrayType(T.StringType())
PAGE = T.StructType(
    [
        T.StructField("title", _text),
        *[T.StructField(h, _text) for h in _HEADINGS],
        T.StructField("canonical", _text),
        T.StructField("metas", T.ArrayType(T.StructType([T.StructField("key", _text), T.StructField("content", _text)]))),
        T.StructField("links", _texts),
        T.StructField("scripts", _texts),
        T.StructField("jsonld", _texts),
        T.StructField("lines", _texts),
        T.StructField("terms", T.ArrayType(T.StructType([T.StructField("label", _text), T.StructField("value", _text)]))),
        T.StructField("cells", T.ArrayType(T.StructType([T.StructField("label", _text), T.StructField("value", _text)]))),
        T.StructField("telling", _texts),
        T.StructField("picked", T.MapType(_text, _text)),
    ]
)


class Selector:
    """A compiled selector; ``key`` is how it was written."""

    def __init__(self, key: str) -> None:
        self.key, rest = key, key
        rest, _, pattern = rest.partition(" ~ ")
        rest, _, written = rest.partition(" @~ ")
        rest, _, self.attr = rest.partition("@")
        *outer, own = rest.split(" ")
        self.outer = Selector(outer[0]) if outer else None
        self.text = re.compile(pattern) if pattern else None
        self.written = re.compile(written) if written else None
        self.tag, name, self.value = re.fullmatch(r"(\w*)(?:([.#]|\[[\w-]+=)([^\]]*)\]?)?", own).groups()
        self.name = {".": "class", "#": "id", None: None}.get(name, name[1:-1] if name and name[0] == "[" else None)
        self.value = (self.value or "").lower()
        self.equal = name == "#"

    def fits(self, tag: Tag) -> bool:
        if self.name:
            if self.value not in tag.low:
                return False
            have = tag.attributes.get(self.name)
            if have is None or (have.lower() != self.value if self.equal else self.value not in have.lower()):
                return False
        return self.written is None or self.written.search(tag.body) is not None


class Tag:
    """An opening tag; its attributes are read when they are asked for."""

    __slots__ = ("body", "low", "read")

    def __init__(self, body: str) -> None:
        self.body, self.low, self.read = body, body.lower(), None

    @property
    def attributes(self) -> dict[str, str]:
        if self.read is None:
            self.read = _attributes(self.body)
        return self.read


def squeeze(t: str) -> str:
    return _SPACE.sub(" ", entities.unescape(t) if "&" in t else t).strip(" ")


def _attributes(body: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(body):
        out.setdefault(name.lower(), double or single or bare)
    return out


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, past quoted values; the end of the page if none does."""
    while True:
        m = _EDGE.search(page, at)
        if m is None:
            return len(page)
        if m[0] == ">":
            return m.start()
        closing = page.find(m[0][-1], m.end())
        at = closing + 1 if closing >= 0 else m.end()


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, value)`` in order: text, hidden, open, close.

    A comment or declaration is ``hidden``, as is the body of an element that shows
    nothing, which follows its ``open`` event; an unclosed one goes to the end of the page.
    """
    at = 0
    while True:
        m = _MARK.search(page, at)
        if m is None:
            break
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            yield "hidden", "", ""
            continue
        end = _tag_end(page, m.end()) if m[2] else page.find(">", m.end())
        end = len(page) if end < 0 else end
        at = end + 1
        if not m[2]:
            yield "hidden", "", ""
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, page[m.end() : end]
        if name in _CLOSERS:
            closer = _CLOSERS[name].search(page, at)
            body = page[at : closer.start() if closer else len(page)]
            at = closer.end() if closer else len(page)
            yield ("text" if name == "title" else "hidden"), name, body
            yield "close", name, ""
    if at < len(page):
        yield "text", "", page[at:]


_BARE = Tag("")


class _Scan:
    def __init__(self, selectors: list[Selector]) -> None:
        every = [*selectors, *[s.outer for s in selectors if s.outer is not None]]
        self.wanted = {id(s) for s in selectors}
        self.by_tag: dict[str, list[Selector]] = {}
        for s in every:
            self.by_tag.setdefault(s.tag, []).append(s)
        self.texts = [s for s in selectors if s.text is not None]
        self.inside: Counter = Counter()  # open elements by selector
        self.open_names: Counter = Counter()
        self.stack: list[tuple] = []  # name, kind, first line, selectors met, picks to fill, label before, telling
        self.scopes: list[dict[str, int]] = [{}]
        self.lines: list[str] = []
        self.pending: list[str] = []
        self.cell_texts: list[list[str]] = []
        self.label: tuple | None = None  # a label whose value may follow at once
        self.telling = False
        self.found: dict = {"title": None, **dict.fromkeys(_HEADINGS), "canonical": None, "picked": {}}
        for name in ("metas", "links", "scripts", "jsonld", "terms", "cells", "telling"):
            self.found[name] = []

    def flush(self) -> None:
        line = squeeze(" ".join(self.pending) if len(self.pending) > 1 else self.pending[0])
        self.pending.clear()
        if not line:
            return
        self.lines.append(line)
        self.label = None
        if self.cell_texts:
            self.cell_texts[-1].append(line)
        picked = self.found["picked"]
        for s in self.texts:
            if self.inside[id(s)] and s.key not in picked and s.text.search(line):
                picked[s.key] = line

    def open(self, name: str, body: str) -> None:
        if self.pending:
            self.flush()
        kind = _KIND.get(name)
        if kind:
            for one in ("cell", "row") if kind == "row" else (kind,):
                if one in self.scopes[-1]:
                    self.pop_to(self.scopes[-1][one])
        tag = Tag(body) if body else _BARE
        if name in _NOTED:
            self.note(name, tag)
        met, fill = [], []
        for group in (self.by_tag.get(name, ()), self.by_tag.get("", ()) if body else ()):
            for s in group:
                if s.fits(tag) and (s.outer is None or self.inside[id(s.outer)]):
                    met.append(s)
                    if id(s) in self.wanted and s.text is None and s.key not in self.found["picked"]:
                        self.meet(s, tag, fill)
        label, self.label = self.label, None
        if name in _VOID or body.endswith("/"):
            return
        for s in met:
            self.inside[id(s)] += 1
        if kind:
            self.scopes[-1][kind] = len(self.stack)
            if kind in ("cell", "term"):
                self.cell_texts.append([])
        if name in _SCOPES:
            self.scopes.append({})
        telling = not self.telling and name in _TELLING and (name in _HEADINGS or name == "button" or _TELLING_WORDS.search(body) is not None)
        self.telling |= telling
        self.stack.append((name, kind, len(self.lines), met, fill, label[1] if label and label[0] == name else None, telling))
        self.open_names[name] += 1

    def meet(self, s: Selector, tag: Tag, fill: list[str]) -> None:
        """The first element of a selector gives its value now, or its text when it closes."""
        if not s.attr:
            self.found["picked"][s.key] = ""
            fill.append(s.key)
        elif s.attr in tag.attributes:
            self.found["picked"][s.key] = squeeze(tag.attributes[s.attr])

    def note(self, name: str, tag: Tag) -> None:
        """Tags that say something by themselves."""
        a = tag.attributes
        if name == "meta":
            keys = [squeeze(a.get(k, "")) for k in ("property", "name", "itemprop")]
            key, content = next((k for k in keys if k), ""), entities.unescape(a.get("content", "")).strip(" ")
            if key and content:
                self.found["metas"].append({"key": key.lower(), "content": content})
        elif name == "a" and "href" in a:
            self.found["links"].append(a["href"])
        elif name == "link" and self.found["canonical"] is None and "canonical" in a.get("rel", "").lower():
            self.found["canonical"] = squeeze(a.get("href", "")) or None

    def pop_to(self, depth: int) -> None:
        """Close open elements down to this depth."""
        while len(self.stack) > depth:
            name, kind, first, met, fill, label, telling = self.stack.pop()
            self.open_names[name] -= 1
            for s in met:
                self.inside[id(s)] -= 1
            if name in _SCOPES:
                self.scopes.pop()
            heading = name in _HEADINGS and self.found[name] is None
            if fill or telling or heading:
                shown = " ".join(self.lines[first:])
                for key in fill:
                    self.found["picked"][key] = shown
                if telling:
                    self.telling = False
                    self.found["telling"].append(shown)
                if heading:
                    self.found[name] = shown
            self.label = None
            if kind:
                self.scopes[-1].pop(kind, None)
                if kind in ("cell", "term"):
                    shown = " ".join(self.cell_texts.pop())
                    if label is not None:
                        self.found["terms" if kind == "term" else "cells"].append({"label": label, "value": shown})
                    self.label = ({"th": "td", "dt": "dd"}.get(name), shown.lower())

    def close(self, name: str) -> None:
        if self.pending:
            self.flush()
        if not self.open_names[name]:
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != name:
            k -= 1
        self.pop_to(k)

    def run(self, page: str) -> dict:
        script = ""
        for kind, name, value in events(page):
            if kind == "text":
                self.pending.append(value)
                if name == "title" and self.found["title"] is None:
                    self.found["title"] = squeeze(value)
            elif kind == "hidden":
                self.pending.append(" ")
                if name == "script" and value.strip(" "):
                    self.found["scripts"].append(value)
                    if "ld+json" in script:
                        self.found["jsonld"].append(value)
            elif name in _RAW:  # shows nothing and does not part a text
                script = _attributes(value).get("type", "").lower() if kind == "open" and name == "script" else ""
            elif kind == "open":
                self.open(name, value)
            else:
                self.close(name)
        if self.pending:
            self.flush()
        self.pop_to(0)
        return {**self.found, "lines": self.lines}


def scan(page: str | None, selectors: list[Selector] = ()) -> dict:
    """What one page holds; see ``PAGE``.  ``picked`` has the first element of each selector."""
    return _Scan(list(selectors)).run(page or "")


@functools.cache
def _page_type() -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(PAGE)


def _column(pages: list[dict]) -> pa.Array:
    return pa.array([{**p, "picked": list(p["picked"].items())} for p in pages], _page_type())


@F.arrow_udf(PAGE)
def scan_page(html: pa.Array) -> pa.Array:
    """The parts of a page as a struct."""
    return _column([scan(h) for h in html.to_pylist()])


def scanner(by_site: Mapping[str, list[str]], common: list[str]):
    """A function ``(html, site)`` that also picks the selectors of a page's own site and the common ones."""

    @F.arrow_udf(PAGE)
    def scan_site(html: pa.Array, site: pa.Array) -> pa.Array:
        compiled = functools.cache(lambda s: [Selector(k) for k in dict.fromkeys([*by_site.get(s, ()), *common])])
        return _column([scan(h, compiled(s)) for h, s in zip(html.to_pylist(), site.to_pylist())])

    return scan_site
