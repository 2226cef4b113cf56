"""The html scanner: sound, nested and broken pages."""

from __future__ import annotations

import time

import pytest

from tagworth.functions import html as h
from tagworth.functions.scan import Selector, events, scan

SELECTORS = [".price", "#x", "span.price", "button ~ (?i)add to bag", "main button", "[buyer-country=]@buyer-country", "a ~ x"]


def picked(page, *keys):
    return scan(page, [Selector(k) for k in keys])["picked"]


def test_fields():
    p = scan(
        "<!DOCTYPE html><html><head><title>A &amp; B</title><meta property='og:title' content='T &lt;1&gt;'><meta content=9 itemprop=Price>"
        "<link rel='canonical' href='https://x.com/p'><script type='application/ld+json'>{\"a\": \"<b>\"}</script><style>b{}</style></head>"
        "<body><h1>Big <b>bag</b></h1><a href='/1'>one</a> <A HREF=/2>two</A><!-- <p>no</p> --><noscript><p>no</p></noscript><p>x&nbsp; y</p></body>"
    )
    assert (p["title"], p["h1"], p["canonical"], p["links"]) == ("A & B", "Big bag", "https://x.com/p", ["/1", "/2"])
    assert p["metas"] == [{"key": "og:title", "content": "T <1>"}, {"key": "price", "content": "9"}]
    assert p["jsonld"] == p["scripts"] == ['{"a": "<b>"}']
    assert p["lines"] == ["A & B", "Big", "bag", "one", "two", "x y"]


def test_quotes_hide_brackets():
    assert picked("<div class='a>b' id=\"x\">in</div>", "#x") == {"#x": "in"}
    assert picked("<div id='x' class=\"price>in</div><p>later</p>", "#x") == {"#x": "in"}  # never closed: not a quote
    assert scan("a < b and c > d <3")["lines"] == ["a < b and c > d <3"]


def test_hidden_parts_do_not_part_a_text():
    assert scan("<p>a<!-- c -->b<script>x</script>c</p>d")["lines"] == ["a b c", "d"]


def test_tables():
    sound = "<table><tr><th>Condition</th><td>Good</td></tr><tr><th>From</th> <td>Rome, <b>Italy</b></td></tr></table><dl><dt>Size</dt><dd>M</dd></dl>"
    loose = "<table><tr><th>Condition<td>Good<tr><th>From<td>Rome, <b>Italy</b></table><dl><dt>Size<dd>M</dl>"
    for page in (sound, loose):
        p = scan(page)
        assert p["cells"] == [{"label": "condition", "value": "Good"}, {"label": "from", "value": "Rome, Italy"}]
        assert p["terms"] == [{"label": "size", "value": "M"}]
    nested = "<table><tr><th>Outer</th><td>a<table><tr><th>Inner</th><td>b</td></tr></table>c</td></tr></table>"
    assert scan(nested)["cells"] == [{"label": "inner", "value": "b"}, {"label": "outer", "value": "a c"}]
    assert scan("<table><tr><th>A</th></tr><tr><td>b</td></tr><tr><th>C</th>x<td>d</td></tr></table>")["cells"] == []


def test_selectors():
    page = (
        "<main><div class='a price-box'><span class='price'>1<span>2</span>3</span></div><button disabled>Add to <b>bag</b></button>"
        "<button>Add to bag</button></main><span CLASS='PRICE'>4</span><i buyer-country='FR'></i><input id=x>"
    )
    got = picked(page, ".price", "span.price", "#x", "main button", "main i", "button ~ (?i)add to bag", "a ~ x", "[buyer-country=]@buyer-country", "button @~ disabled ~ bag", ".none")
    assert got == {
        ".price": "1 2 3", "span.price": "1 2 3", "#x": "", "main button": "Add to bag", "button ~ (?i)add to bag": "Add to bag",
        "[buyer-country=]@buyer-country": "FR", "button @~ disabled ~ bag": "bag",
    }


def test_unclosed_elements_end_with_the_page_or_their_parent():
    assert picked("<div class=price>a<p>b</div>c", ".price") == {".price": "a b"}
    assert picked("<div class=price>a<p>b", ".price") == {".price": "a b"}
    assert scan("</p></div>x</b>")["lines"] == ["x"]
    assert scan("a<!-- b")["lines"] == ["a"] and scan("a<script>b")["scripts"] == ["b"] and scan("a<b")["lines"] == ["a"]
    assert scan(None)["lines"] == [] and scan("")["title"] is None


def test_events():
    assert list(events("a<B c=d>e</b ><!-- x --><br/>")) == [
        ("text", "", "a"), ("open", "b", " c=d"), ("text", "", "e"), ("close", "b", ""), ("hidden", "", ""), ("open", "br", "/"),
    ]


HOSTILE = [
    "<!--", "<script>", "<script", "<", "<a ", "<a b=\"", "<a b='", "<td>", "<th>a<td>", "<table><tr><td>", '<div class="price">', "<b>", "</b>", "<p>",
    "<a href=x>y", "<title>", "<button>q", "<meta ", "<ul><li>x", "<a b='\">", "<h1>x", "&amp;", "<x y=z", "<div id=x>", "<p class=status>a",
]


@pytest.mark.parametrize("bit", HOSTILE)
def test_broken_pages_cost_what_sound_ones_cost(bit):
    """Time grows in proportion: four times the page, about four times as long."""

    def seconds(size):
        page = bit * (size // len(bit))
        best = 9e9
        for _ in range(2):
            start = time.process_time()
            scan(page, [Selector(s) for s in SELECTORS])
            best = min(best, time.process_time() - start)
        return best

    small, large = seconds(125_000), seconds(500_000)
    assert large < 2 and large < 0.05 + 9 * small


def test_columns_share_a_scan_and_stand_broken_pages(spark):
    pages = spark.createDataFrame([(1, "<!--" * 250_000), (2, "<script>" * 125_000), (3, None), (4, "<p>Fine</p>")], "page_id int, html string")
    start = time.time()
    out = pages.select("page_id", h.visible_text("html").alias("t"), h.page_title("html").alias("n"), h.links("html").alias("l"))
    assert {r.page_id: r.t for r in out.collect()} == {1: "", 2: "", 3: "", 4: "fine"}
    assert time.time() - start < 20
    assert out._jdf.queryExecution().executedPlan().toString().count("scan_page(") <= 2
