"""Extraction rules per site, as data.

A rule is ``(site, field, level, kind, pattern)``; the lowest level with a value wins.
Kinds: ``objects`` (JSON-LD), ``state`` (script JSON), ``script`` (regular expression on
scripts, first group), ``meta`` (comma-separated keys), ``element`` (selector),
``lenient`` (selector, price in any form), ``attr`` (selector@attribute), ``universal`` (generic
price search), ``matched`` (objects carrying the page's product id), ``scored`` (scored
script prices), ``lines`` (labelled text lines), ``anchor`` (lines near the buy button),
``heading`` (first h1), ``has`` (any of the selectors, separated by ``||``), ``script_has``
(a word and a pattern in one script), ``text`` (pattern on visible text), ``value`` (the price
was found).  Selectors are those of :mod:`tagworth.functions.scan`.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    site: str
    field: str
    level: int
    kind: str
    pattern: str = ""


# Currency of a price without one, per site; "page" guesses from the page text.
DEFAULT_CURRENCY = {
    "ebay": "USD",
    "poshmark": "USD",
    "vestiairecollective": "page",
    "rebag": "USD",
    "theluxurycloset": "USD",
    "fashionphile": "USD",
    "jolicloset": "EUR",
    "yoogiscloset": "USD",
    "therealreal": "USD",
    "celebrityowned": "EUR",
    "aretrotale": "EUR",
    "dallasdesignerhandbags": "USD",
    "popchill": "TWD",
    "designerexchange": "GBP",
    "annsfabulousfinds": "USD",
}
# Status when no rule hits.
DEFAULT_STATUS = {
    "ebay": "Unknown",
    "poshmark": "Unknown",
    "vestiairecollective": "Sold",
    "rebag": "Sold Out",
    "theluxurycloset": None,
    "fashionphile": "Sold Out",
    "jolicloset": "Sold Out",
    "yoogiscloset": "Unknown",
    "therealreal": None,
    "celebrityowned": "Sold Out",
    "aretrotale": "Sold Out",
    "dallasdesignerhandbags": "Sold Out",
    "popchill": "Sold Out",
    "designerexchange": "Sold Out",
    "annsfabulousfinds": "Sold Out",
}
# Sold pages of these sites carry no price.
SOLD_VOIDS_PRICE = ["fashionphile", "yoogiscloset", "dallasdesignerhandbags"]
# Sites whose own price is final: the generic parser adds only title and status.
STRICT_AVAILABILITY = ["poshmark"]

_PRICE_META = "product:price:amount,og:price:amount,price"

RULES: list[Rule] = [
    # ebay
    Rule("ebay", "title", 1, "objects"),
    Rule("ebay", "title", 2, "heading"),
    Rule("ebay", "title", 3, "meta", "og:title"),
    Rule("ebay", "price", 1, "objects"),
    Rule("ebay", "price", 2, "state"),
    Rule("ebay", "price", 3, "element", "#prcIsum"),
    Rule("ebay", "price", 4, "element", "#mm-saleDscPrc"),
    Rule("ebay", "price", 5, "element", ".x-price-primary"),
    Rule("ebay", "price", 6, "element", ".x-bin-price__content"),
    Rule("ebay", "price", 7, "element", ".x-item-condensed-card__price"),
    Rule("ebay", "price", 8, "element", "span[itemprop=price]"),
    Rule("ebay", "price", 9, "meta", _PRICE_META),
    Rule("ebay", "price", 10, "universal"),
    Rule("ebay", "available", 1, "objects"),
    Rule("ebay", "sold", 2, "text", "this listing was ended|listing has ended|sold out|out of stock"),
    Rule("ebay", "available", 3, "has", "span ~ Buy It Now|Sofort-Kaufen|Achat immédiat || [id=binBtn_btn] || button.ux-call-to-action"),
    Rule("ebay", "condition", 1, "element", ".x-item-condition-text"),
    # poshmark
    Rule("poshmark", "title", 1, "objects"),
    Rule("poshmark", "title", 2, "element", "h1.listing__title-container"),
    Rule("poshmark", "title", 3, "meta", "og:title"),
    Rule("poshmark", "price", 1, "element", "[data-test=listing-price]"),
    Rule("poshmark", "price", 2, "element", "[data-testid=listing-price]"),
    Rule("poshmark", "price", 3, "objects"),
    Rule("poshmark", "price", 4, "meta", "og:price:amount,product:price:amount"),
    Rule("poshmark", "price", 5, "script", "(?is)\"listing_price\"\\s*:\\s*\\{[^{}]{0,260}?\"amount\"\\s*:\\s*\"?([0-9]+(?:\\.[0-9]+)?)"),
    Rule("poshmark", "price", 6, "script", "(?i)\"price_amount\"\\s*:\\s*\"?([0-9]+(?:\\.[0-9]+)?)"),
    Rule("poshmark", "price", 7, "script", "(?i)\"price\"\\s*:\\s*\"?([0-9]+(?:\\.[0-9]+)?)"),
    Rule("poshmark", "price", 8, "element", ".listing__info"),
    Rule("poshmark", "price", 9, "universal"),
    Rule("poshmark", "available", 1, "objects"),
    Rule("poshmark", "sold", 2, "has", ".listing__inventory-status ~ (?i)sold|out of stock|not for sale|no longer available"),
    Rule("poshmark", "available", 3, "has", "button ~ (?i)Buy Now || a ~ (?i)Buy Now"),
    Rule("poshmark", "condition", 1, "described", ".listing__description"),
    # vestiaire collective
    Rule("vestiairecollective", "title", 1, "element", "span[data-cy=productTitle_name]"),
    Rule("vestiairecollective", "title", 2, "heading"),
    Rule("vestiairecollective", "price", 1, "objects"),
    Rule("vestiairecollective", "price", 2, "meta", _PRICE_META),
    Rule("vestiairecollective", "price", 3, "state"),
    Rule("vestiairecollective", "price", 4, "element", "[data-cy=product_price]"),
    Rule("vestiairecollective", "price", 5, "element", "span.product-price"),
    Rule("vestiairecollective", "price", 6, "element", "span.price-amount"),
    Rule("vestiairecollective", "price", 7, "universal"),
    Rule("vestiairecollective", "available", 1, "has", "button[data-cy=pdp_buy_btn]"),
    Rule("vestiairecollective", "condition", 1, "labeled", "[data-cy=condition]"),
    # rebag
    Rule("rebag", "title", 1, "element", "#pdp__title"),
    Rule("rebag", "title", 2, "meta", "og:title"),
    Rule("rebag", "title", 3, "heading"),
    Rule("rebag", "price", 1, "universal"),
    Rule("rebag", "price", 2, "element", "#pdp__price"),
    Rule("rebag", "price", 3, "element", ".product-price"),
    Rule("rebag", "sold", 1, "has", "#pdp__get-notified ~ (?i)set back in stock alert"),
    Rule("rebag", "available", 2, "has", "#add-to-cart-button-input"),
    Rule("rebag", "condition", 1, "element", "li.pdp__condition-item--selected"),
    Rule("rebag", "condition", 2, "script", "(?i)\\bCondition\\b\\s*:\\s*([A-Za-z][A-Za-z /'-]{1,40})"),
    # the luxury closet
    Rule("theluxurycloset", "title", 1, "element", "h1.ProductDetailsCard__productName"),
    Rule("theluxurycloset", "title", 2, "heading"),
    Rule("theluxurycloset", "title", 3, "meta", "og:title"),
    Rule("theluxurycloset", "price", 1, "element", ".ProductPriceV2__newProductPrice"),
    Rule("theluxurycloset", "price", 2, "element", ".newProductPrice"),
    Rule("theluxurycloset", "price", 3, "element", "[data-testid=product-price/final]"),
    Rule("theluxurycloset", "price", 4, "matched", "state"),
    Rule("theluxurycloset", "price", 5, "meta", _PRICE_META),
    Rule("theluxurycloset", "price", 6, "matched", "objects"),
    Rule("theluxurycloset", "price", 7, "nearby"),
    Rule("theluxurycloset", "sold", 1, "has", ".soldOuttitle || .outOfStock || .soldout"),
    Rule("theluxurycloset", "sold", 2, "text", "sold out|out of stock|currently unavailable|this item is sold"),
    Rule("theluxurycloset", "available", 3, "matched_status"),
    Rule("theluxurycloset", "available", 4, "has", "button ~ (?i)add to bag|add to cart|buy now|shop now || a ~ (?i)add to bag|add to cart|buy now|shop now"),
    Rule("theluxurycloset", "available", 5, "value"),
    Rule("theluxurycloset", "condition", 1, "element", ".ItemCondition__selectedIndex"),
    Rule("theluxurycloset", "condition", 2, "script", "(?i)\"(?:itemCondition|condition|selectedIndex)\"\\s*:\\s*\"([^\"]{2,40})\""),
    # fashionphile
    Rule("fashionphile", "title", 1, "heading"),
    Rule("fashionphile", "price", 1, "element", "span.price-item"),
    Rule("fashionphile", "price", 2, "element", "span.price"),
    Rule("fashionphile", "sold", 1, "has", ".fp-pdp-badges__container .price__badge-sold-out || .fp-pdp-badges__container ~ (?i)sold out"),
    Rule("fashionphile", "available", 2, "has", "button ~ (?i)Add to Bag || button[id=ProductSubmitButton-template--]"),
    Rule("fashionphile", "condition", 1, "attr", ".fp-condition-thermometer@aria-valuetext"),
    Rule("fashionphile", "condition", 2, "element", ".fp-font-weight--regular"),
    # jolicloset
    Rule("jolicloset", "title", 1, "heading"),
    Rule("jolicloset", "title", 2, "meta", "og:title"),
    Rule("jolicloset", "price", 1, "lenient", "span.price"),
    Rule("jolicloset", "price", 2, "lenient", "div.price"),
    Rule("jolicloset", "price", 3, "meta", "product:price:amount,og:price:amount"),
    Rule("jolicloset", "sold", 1, "has", ".sold || .outOfStock || .out-of-stock"),
    Rule("jolicloset", "sold", 2, "text", "sold out|out of stock|currently unavailable|vendu|ausverkauft"),
    Rule("jolicloset", "available", 3, "has", "[id=addCartButton] || button ~ (?i)add to cart|add to bag|buy now || a ~ (?i)add to cart|add to bag|buy now"),
    Rule("jolicloset", "available", 4, "value"),
    Rule("jolicloset", "condition", 1, "element", "[data-remote=itemConditions/]"),
    # yoogi's closet
    Rule("yoogiscloset", "title", 1, "element", "h1[itemprop=name]"),
    Rule("yoogiscloset", "title", 2, "heading"),
    Rule("yoogiscloset", "price", 1, "element", "span[itemprop=price]"),
    Rule("yoogiscloset", "price", 2, "universal"),
    Rule("yoogiscloset", "sold", 1, "any_sold"),
    Rule("yoogiscloset", "sold", 2, "has", "[itemprop=availability] @~ (?i)out ?of ?stock|sold ?out|unavailable || [property=availability] @~ (?i)out ?of ?stock|sold ?out|unavailable || [name=availability] @~ (?i)out ?of ?stock|sold ?out|unavailable"),
    Rule("yoogiscloset", "sold", 3, "text", "recently sold|sold out|out of stock|no longer available|this item has sold"),
    Rule("yoogiscloset", "sold", 4, "has", "button @~ (?i)\\s(?:disabled|aria-disabled=[\"\'](?:true|1)) ~ (?i)add to (?:shopping )?bag"),
    Rule("yoogiscloset", "available", 5, "has", "button ~ (?i)add to (?:shopping )?bag"),
    Rule("yoogiscloset", "available", 6, "value"),
    # the realreal
    Rule("therealreal", "title", 1, "objects"),
    Rule("therealreal", "title", 2, "element", "[data-testid=product-name]"),
    Rule("therealreal", "title", 3, "heading"),
    Rule("therealreal", "title", 4, "meta", "og:title,twitter:title"),
    Rule("therealreal", "price", 1, "element", "[data-testid=product-price/final]"),
    Rule("therealreal", "price", 2, "element", ".product-price-info__final-price"),
    Rule("therealreal", "price", 3, "element", ".product-price-info__reduced-price"),
    Rule("therealreal", "price", 4, "scored", "payload"),
    Rule("therealreal", "price", 5, "objects"),
    Rule("therealreal", "price", 6, "meta", _PRICE_META),
    Rule("therealreal", "price", 7, "scored", "scripts"),
    Rule("therealreal", "price", 8, "lines"),
    Rule("therealreal", "price", 9, "anchor"),
    Rule("therealreal", "sold", 1, "has", "[data-testid=sold] || .sold"),
    Rule("therealreal", "sold", 2, "text", "sold out|out of stock|this item has sold|this item is sold"),
    Rule("therealreal", "available", 3, "has", "[data-testid=add-to-bag] || [data-testid=add_to_bag] || [data-testid=add-to_bag] || [data-testid=add_to-bag] || button ~ (?i)add to bag || a ~ (?i)add to bag"),
    Rule("therealreal", "available", 4, "objects"),
    Rule("therealreal", "condition", 1, "element", "li[data-testid=product-condition-active]"),
    # celebrityowned
    Rule("celebrityowned", "title", 1, "element", "h3[itemprop=name]"),
    Rule("celebrityowned", "price", 1, "attr", "#ProductPrice@content"),
    Rule("celebrityowned", "price", 2, "element", "#ProductPrice"),
    Rule("celebrityowned", "price", 3, "element", "span.price"),
    Rule("celebrityowned", "price", 4, "element", "span[itemprop=price]"),
    Rule("celebrityowned", "available", 1, "has", "span.product-count ~ ^[^0-9]*0*[1-9]"),
    Rule("celebrityowned", "condition", 1, "described", "[itemprop=description]"),
    # a retro tale
    Rule("aretrotale", "title", 1, "element", "#sg-pdp-product-title"),
    Rule("aretrotale", "price", 1, "universal"),
    Rule("aretrotale", "price", 2, "element", "#sg-pdp-product-price"),
    Rule("aretrotale", "price", 3, "element", "span.price"),
    Rule("aretrotale", "available", 1, "has", "p ~ ADD TO CART"),
    Rule("aretrotale", "condition", 1, "element", "p.uppercase span"),
    # dallas designer handbags
    Rule("dallasdesignerhandbags", "title", 1, "element", "h1.product"),
    Rule("dallasdesignerhandbags", "title", 2, "element", "h2.name"),
    Rule("dallasdesignerhandbags", "title", 3, "heading"),
    Rule("dallasdesignerhandbags", "price", 1, "universal"),
    Rule("dallasdesignerhandbags", "price", 2, "element", "#ProductPrice-product-template"),
    Rule("dallasdesignerhandbags", "price", 3, "element", "span.price"),
    Rule("dallasdesignerhandbags", "sold", 1, "text", "sold out|out of stock|unavailable"),
    Rule("dallasdesignerhandbags", "available", 2, "has", "button ~ (?i)add to cart|buy now || a ~ (?i)add to cart|buy now"),
    Rule("dallasdesignerhandbags", "available", 3, "script_has", "productJson||\"available\"\\s*:\\s*true"),
    Rule("dallasdesignerhandbags", "available", 4, "has", "span.in-stock"),
    Rule("dallasdesignerhandbags", "condition", 1, "labeled", ".tags_condition"),
    Rule("dallasdesignerhandbags", "condition", 2, "rank", "(?is)condition details.{0,600}?\\brank\\s*([A-Za-z]{1,2})\\b"),
    # popchill
    Rule("popchill", "title", 1, "heading"),
    Rule("popchill", "price", 1, "meta", "og:price:amount,product:price:amount"),
    Rule("popchill", "price", 2, "objects"),
    Rule("popchill", "price", 3, "html_price", "span ~ ^(?:NT\\$|HK\\$|TWD)\\s*[0-9][0-9,.]*$"),
    Rule("popchill", "available", 1, "has", "main button"),
    # designer exchange
    Rule("designerexchange", "title", 1, "element", "h4.pname"),
    Rule("designerexchange", "price", 1, "universal"),
    Rule("designerexchange", "price", 2, "element", ".prodetails-pricebox"),
    Rule("designerexchange", "price", 3, "element", "span.price"),
    Rule("designerexchange", "available", 1, "has", "a ~ ADD TO BASKET"),
    Rule("designerexchange", "condition", 1, "described", ".product-condition-container"),
    # ann's fabulous finds
    Rule("annsfabulousfinds", "title", 1, "element", "h1.title"),
    Rule("annsfabulousfinds", "price", 1, "element", "h2.actual-price"),
    Rule("annsfabulousfinds", "price", 2, "element", "span.price"),
    Rule("annsfabulousfinds", "price", 3, "element", "h2.price"),
    Rule("annsfabulousfinds", "price", 4, "html_price", "h2 ~ \\$"),
    Rule("annsfabulousfinds", "available", 1, "has", "#add_to_cart"),
    Rule("annsfabulousfinds", "condition", 1, "element", ".aff_star_rating"),
]

# Scored script prices: (pattern with the amount in group 1, base score, amount in cents).
_AMOUNT = "([0-9][0-9,]*(?:\\.[0-9]+)?)"
SCORED_PAYLOAD: list[tuple[str, int, bool]] = [
    ("(?i)\"__typename\"\\s*:\\s*\"Pricing\"[^<]{0,220}?\"usdCents\"\\s*:\\s*\"?([0-9]{3,})\"", 38, True),
    ("(?i)\"__typename\"\\s*:\\s*\"Pricing\"[^<]{0,220}?\"unformatted\"\\s*:\\s*\"?" + _AMOUNT + "\"", 36, False),
    ("(?i)\"(?:final|current|sale|reduced|display|offer)[A-Za-z0-9_-]*price\"\\s*:\\s*\"?\\$?" + _AMOUNT + "\"", 26, False),
    ("(?i)\"(?:final|current|sale|reduced|display|offer)[A-Za-z0-9_-]*price(?:cents|incents)\"\\s*:\\s*\"?([0-9]{3,})\"", 24, True),
]
SCORED_SCRIPTS: list[tuple[str, int, bool]] = [
    ("(?i)\"usdCents\"\\s*:\\s*\"?([0-9]{3,})", 34, True),
    ("(?i)\"unformatted\"\\s*:\\s*\"?" + _AMOUNT, 32, False),
    ("(?i)\"finalPrice\"\\s*:\\s*\"?\\$?" + _AMOUNT, 30, False),
    ("(?i)\"salePrice\"\\s*:\\s*\"?\\$?" + _AMOUNT, 26, False),
    ("(?i)\"currentPrice\"\\s*:\\s*\"?\\$?" + _AMOUNT, 24, False),
    ("(?i)\"(?:finalPriceCents|salePriceCents|currentPriceCents|priceCents|priceInCents)\"\\s*:\\s*\"?([0-9]{3,})", 22, True),
    ("(?i)\"price\"\\s*:\\s*\"?\\$?" + _AMOUNT, 18, False),
]
PROMO_CONTEXT = ["estimated retail", "est. retail", "est retail", "site credit", "you save", "shipping", "tax"]

# Catalog pages: (card pattern, least cards), (link pattern, least links).
CATALOG_RULES = {
    "vestiairecollective": (
        "(?:data-testid|data-cy|class)=[\"'][^\"']*(?:product-card|productCard|ProductCard)", 3,
        "href=[\"'][^\"']*/women-[^\"']*\\.shtml", 4,
    ),
    "therealreal": (
        "(?:data-testid|class)=[\"'][^\"']*(?:product-tile|product-card|ProductTile|ProductCard)", 3,
        "href=[\"'][^\"']*/products/", 5,
    ),
}
SCRIPT_PRICE_KEYS = [
    "price", "priceValue", "currentPrice", "salePrice", "finalPrice", "soldPrice", "amount", "value",
]
# Signs of a product page behind a block marker: tags and words.
PRODUCT_TAGS = ("link @~ (?i)/products/", "meta @~ (?i)/products/")
PRODUCT_SIGNALS = (
    "(?is)product-price/final|add-to-bag|ProductDetailsCard__productName|"
    "ProductPriceV2__newProductPrice|ItemCondition__selectedIndex|soldOuttitle|\"@type\"\\s*:\\s*\"Product\""
)
