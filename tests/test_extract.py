"""Small synthetic pages: one per site, plus sold, blocked, catalog and mismatch cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tagworth.operators import extract as e


def ld(**kw) -> str:
    return f'<script type="application/ld+json">{json.dumps(kw)}</script>'


def product(name="Classic Flap", price="2199.50", currency="EUR", stock="InStock", **kw) -> str:
    offer = {"price": price, "priceCurrency": currency, "availability": f"https://schema.org/{stock}"}
    return ld(**{"@type": "Product", "name": name, "offers": offer, **kw})


# name: (url, html, title, price, currency, status, condition, country)
PAGES = {
    "ebay": (
        "https://www.ebay.co.uk/itm/123",
        f"<title>x</title>{product('Classic Flap | eBay')}<div class='x-item-condition-text'><span>Pre-owned</span></div>",
        "Classic Flap", 2199.5, "EUR", "Available", "Pre-owned", "UK",
    ),
    "ebay_sold": (
        "https://www.ebay.com/itm/5",
        "<h1>Tote</h1><span id='prcIsum'>US $450.00</span><p>This listing was ended by the seller</p>",
        "Tote", 450.0, "USD", "Sold", None, "US",
    ),
    "ebay_state": (
        "https://www.ebay.de/itm/5",
        '<h1>Tasche</h1><script>var _oa = {"title":"Tasche","price":"320.00","priceCurrency":"EUR"};</script><span>Sofort-Kaufen</span>',
        "Tasche", 320.0, "EUR", "Available", None, "DE",
    ),
    "poshmark": (
        "https://poshmark.com/listing/a-1",
        "<h1 class='listing__title-container'>Soho Bag</h1><p data-test='listing-price'>$ 650 </p><p><s>$900</s></p>"
        "<div class='listing__description'>Gently used, light wear.</div><button>Buy Now</button>",
        "Soho Bag", 650.0, "USD", "Available", "Gently used", "US",
    ),
    "poshmark_preorder": (
        "https://poshmark.com/listing/b-2",
        product("Soho", "400", "USD", "PreOrder"),
        "Soho", 400.0, "USD", "Sold", None, "US",
    ),
    "vestiaire": (
        "https://us.vestiairecollective.com/women-bags/a-55.shtml",
        "<span data-cy='productTitle_name'>Boy bag</span><meta property='product:price:amount' content='1,850'>"
        "<button data-cy='pdp_buy_btn'>Buy</button><p>Price 1,850 £</p>",
        "Boy bag", 1850.0, "GBP", "Available", None, "US",
    ),
    "vestiaire_catalog": (
        "https://www.vestiairecollective.com/women-bags/",
        "<h1>Bags</h1>" + "<div class='product-card'>x</div>" * 3,
        None, None, None, "catalog", None, None,
    ),
    "rebag": (
        "https://shop.rebag.com/products/neverfull-99",
        "<h1 id='pdp__title'>Neverfull MM</h1><div id='pdp__price'><span>$1,345.00</span></div>"
        "<li class='pdp__condition-item--selected'>Excellent</li><input id='add-to-cart-button-input'>",
        "Neverfull MM", 1345.0, "USD", "Available", "Excellent", "US",
    ),
    "rebag_sold": (
        "https://shop.rebag.com/products/x",
        "<h1 id='pdp__title'>Neverfull PM</h1><div id='pdp__get-notified'><button>Set Back in Stock Alert</button></div>",
        "Neverfull PM", None, None, "Sold", None, "US",
    ),
    "tlc": (
        "https://theluxurycloset.com/women/bag-p123",
        "<link rel='canonical' href='https://theluxurycloset.com/women/bag-p123'><h1>Lady Dior</h1>"
        '<script>window.__PRELOADED_STATE__ = {"details":{"id":123,"finalPrice":"3500","currency":"USD"},'
        '"similar":[{"id":124,"finalPrice":"90"}]};</script><button>Add to Bag</button>',
        "Lady Dior", 3500.0, "USD", "Available", None, None,
    ),
    "tlc_mismatch": (
        "https://theluxurycloset.com/women/bag-p123",
        "<link rel='canonical' href='https://theluxurycloset.com/women/other-p999'><h1>Other</h1>"
        "<div class='ProductPriceV2__newProductPrice___1'>$500</div>",
        "Other", None, None, None, None, None,
    ),
    "fashionphile_sold": (
        "https://www.fashionphile.com/products/x",
        "<h1>Pochette</h1><span class='price-item'>$900.00</span>"
        "<div class='fp-pdp-badges__container'><span class='price__badge-sold-out'>Sold Out</span></div>",
        "Pochette", None, None, "Sold", None, "US",
    ),
    "fashionphile": (
        "https://www.fashionphile.com/products/y",
        "<h1>Alma</h1><span class='price-item'>$980.00</span><button><span>Add to Bag</span></button>"
        "<div class='fp-condition-thermometer' aria-valuetext='Very Good'></div>",
        "Alma", 980.0, "USD", "Available", "Very good", "US",
    ),
    "jolicloset": (
        "https://www.jolicloset.com/en/bag--623450",
        "<div id='product'><h1>Kelly 28</h1><span class='price'>1 234,56</span>"
        "<a data-remote='/en/ajax/itemConditions/3'>Good condition</a><button id='addCartButton'>Buy</button></div>",
        "Kelly 28", 1234.56, "EUR", "Available", "Good condition", None,
    ),
    "jolicloset_vendu": (
        "https://www.jolicloset.com/en/bag--623451",
        "<h1>Birkin</h1><p>Vendu</p>",
        "Birkin", None, None, "Sold", None, None,
    ),
    "yoogis_sold": (
        "https://www.yoogiscloset.com/a/b/123",
        f"<h1 itemprop='name'>Speedy</h1>{product('Speedy', '700', 'USD', 'OutOfStock')}",
        "Speedy", None, None, "Sold", None, "US",
    ),
    "yoogis": (
        "https://www.yoogiscloset.com/a/b/124",
        "<h1 itemprop='name'>Speedy</h1><span itemprop='price'>$720.00</span><button>Add To Shopping Bag</button>",
        "Speedy", 720.0, "USD", "Available", None, "US",
    ),
    "realreal": (
        "https://www.therealreal.com/products/women/bag-abc",
        "<h1>Marmont Bag | The RealReal</h1><div data-testid='product-price/final'>$1,095.00</div><button>Add to Bag</button>",
        "Marmont Bag", 1095.0, "USD", "Available", None, "US",
    ),
    "realreal_cents": (
        "https://www.therealreal.com/products/women/bag-abc",
        '<h1>Marmont Bag</h1><script>{"slug":"bag-abc","pricing":{"usdCents":"109500"},"related":"' + 200 * 'x' + '","price":"1200"}</script>'
        "<button>Add to Bag</button>",
        "Marmont Bag", 1095.0, "USD", "Available", None, "US",
    ),
    "realreal_lines": (
        "https://www.therealreal.com/products/women/bag-abd",
        "<h1>Jackie Bag</h1><p>- Price: $995</p><p>Price was $1,500</p><p>Recently viewed</p><p>Price: $10</p><button>Add to Bag</button>",
        "Jackie Bag", 995.0, "USD", "Available", None, "US",
    ),
    "celebrityowned": (
        "https://www.celebrityowned.com/products/a/b",
        "<h3 itemprop='name'>Jumbo Flap</h3><h4 id='ProductPrice' content='2313.95'>€2.313,95</h4>"
        "<span class='product-count'>1 left</span><div itemprop='description'>Excellent condition, no box.</div>",
        "Jumbo Flap", 2313.95, "EUR", "Available", "Excellent", None,
    ),
    "aretrotale": (
        "https://www.aretrotale.com/p/bag-1",
        "<h1 id='sg-pdp-product-title'>Vintage Camera Bag</h1><p id='sg-pdp-product-price'>€750.00</p><p>ADD TO CART</p>",
        "Vintage Camera Bag", 750.0, "EUR", "Available", "Used", None,
    ),
    "dallas": (
        "https://dallasdesignerhandbags.com/products/a",
        "<h1 class='product-name'>Galliera</h1><span id='ProductPrice-product-template'>$525.00</span>"
        '<script>var productJson = {"available":true};</script><div id="srtab-description">Condition Details <ul><li>Rank AB</li></ul></div>',
        "Galliera", 525.0, "USD", "Available", "Excellent", "US",
    ),
    "dallas_sold": (
        "https://dallasdesignerhandbags.com/products/b",
        "<h1>Galliera</h1><span class='price'>$525.00</span><b>Sold out</b>",
        "Galliera", None, None, "Sold", None, "US",
    ),
    "popchill": (
        "https://www.popchill.com/zh-TW/product/12",
        "<main><h1>Pochette Métis</h1><span>HK$ 8,800</span><button>Buy</button></main>",
        "Pochette Métis", 8800.0, "HKD", "Available", None, "TW",
    ),
    "designerexchange": (
        "https://www.designerexchange.com/shop/bag-1",
        "<h4 class='pname'>Bayswater</h4><div class='prodetails-pricebox'>495</div><b>£495.00</b><a href='#'>ADD TO BASKET</a>",
        "Bayswater", 495.0, "GBP", "Available", None, "UK",
    ),
    "annsfabulousfinds": (
        "https://www.annsfabulousfinds.com/products/a",
        "<h1 class='title'>Dionysus</h1><h2 class='actual-price'>$1,150.00</h2><div class='aff_star_rating'>Mint</div><button id='add_to_cart'>Add</button>",
        "Dionysus", 1150.0, "USD", "Available", "Mint", None,
    ),
    "blocked": (
        "https://www.therealreal.com/products/women/bag-x",
        "<title>Access Denied</title><h1>Access to this page has been denied</h1>",
        None, None, None, "blocked", None, "US",
    ),
    "generic": (
        "https://example.com/p/1",
        product("Any bag", "300", "USD", "InStock", itemCondition="https://schema.org/UsedCondition")
        + "<table><tr><th>Ships from</th><td>Milan, Italy</td></tr></table>",
        "Any bag", 300.0, "USD", "Available", "Used", "Italy",
    ),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(name, v[0], v[1], name == "blocked") for name, v in PAGES.items()]
    pages = spark.createDataFrame(rows, "name string, url string, html string, blocked_hint boolean")
    return {r["name"]: r for r in e.extract_listings(pages).collect()}


@pytest.mark.parametrize("name", list(PAGES))
def test_page(parsed, name):
    r = parsed[name]
    want = PAGES[name][2:]
    status = None if r["status"] is None else ("Sold" if "sold" in r["status"].lower() else r["status"])
    assert (r["title"], r["price"], r["currency"], status, r["condition"], r["country"]) == want


def test_page_count_is_kept(parsed):
    assert len(parsed) == len(PAGES)
