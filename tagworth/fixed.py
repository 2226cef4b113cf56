"""Fixed values of the pricing domain: word lists, lookup tables, limits.

Nothing here is logic.  Operators take these as parameter defaults, so a caller
may pass other lists.
"""

from __future__ import annotations

# --- fixed values: sites and domains -------------------------------------------------

SITE_BY_DOMAIN = {
    "poshmark.com": "poshmark",
    "vestiairecollective.com": "vestiairecollective",
    "ebay.com": "ebay",
    "ebay.ca": "ebay",
    "ebay.co.uk": "ebay",
    "ebay.de": "ebay",
    "ebay.fr": "ebay",
    "ebay.it": "ebay",
    "ebay.es": "ebay",
    "ebay.com.au": "ebay",
    "ebay.at": "ebay",
    "ebay.be": "ebay",
    "ebay.ch": "ebay",
    "ebay.ie": "ebay",
    "ebay.nl": "ebay",
    "ebay.pl": "ebay",
    "ebay.in": "ebay",
    "ebay.com.sg": "ebay",
    "ebay.com.hk": "ebay",
    "ebay.com.my": "ebay",
    "ebay.ph": "ebay",
    "rebag.com": "rebag",
    "theluxurycloset.com": "theluxurycloset",
    "fashionphile.com": "fashionphile",
    "jolicloset.com": "jolicloset",
    "yoogiscloset.com": "yoogiscloset",
    "therealreal.com": "therealreal",
    "celebrityowned.com": "celebrityowned",
    "aretrotale.com": "aretrotale",
    "dallasdesignerhandbags.com": "dallasdesignerhandbags",
    "popchill.com": "popchill",
    "designerexchange.com": "designerexchange",
    "annsfabulousfinds.com": "annsfabulousfinds",
}

TIER_BY_SITE = {
    "rebag": 1,
    "ebay": 1,
    "poshmark": 1,
    "vestiairecollective": 1,
    "theluxurycloset": 2,
    "jolicloset": 2,
    "yoogiscloset": 2,
    "therealreal": 2,
    "fashionphile": 3,
    "celebrityowned": 3,
    "aretrotale": 3,
    "dallasdesignerhandbags": 3,
    "popchill": 3,
    "designerexchange": 3,
    "annsfabulousfinds": 3,
}

TIER_WEIGHTS = {1: 1.00, 2: 0.70, 3: 0.65}

SECOND_LEVEL_SUFFIXES = ["co", "com", "ne", "or", "ac"]

# eBay country and marketplace id by regional domain
EBAY_COUNTRY = {
    "ebay.com": "US",
    "ebay.ca": "CA",
    "ebay.co.uk": "UK",
    "ebay.de": "DE",
    "ebay.fr": "FR",
    "ebay.it": "IT",
    "ebay.es": "ES",
    "ebay.com.au": "AU",
    "ebay.at": "AT",
    "ebay.be": "BE",
    "ebay.ch": "CH",
    "ebay.ie": "IE",
    "ebay.nl": "NL",
    "ebay.pl": "PL",
    "ebay.in": "IN",
    "ebay.com.sg": "SG",
    "ebay.com.hk": "HK",
    "ebay.com.my": "MY",
    "ebay.ph": "PH",
}
EBAY_MARKETPLACE = {
    "ebay.com": "EBAY_US",
    "ebay.ca": "EBAY_CA",
    "ebay.co.uk": "EBAY_GB",
    "ebay.de": "EBAY_DE",
    "ebay.fr": "EBAY_FR",
    "ebay.it": "EBAY_IT",
    "ebay.es": "EBAY_ES",
    "ebay.com.au": "EBAY_AU",
    "ebay.at": "EBAY_AT",
    "ebay.be": "EBAY_BE",
    "ebay.ch": "EBAY_CH",
    "ebay.ie": "EBAY_IE",
    "ebay.nl": "EBAY_NL",
    "ebay.pl": "EBAY_PL",
}
SITE_COUNTRY = {
    "poshmark.com": "US",
    "therealreal.com": "US",
    "fashionphile.com": "US",
    "rebag.com": "US",
    "yoogiscloset.com": "US",
    "dallasdesignerhandbags.com": "US",
    "designerexchange.com": "UK",
}
LOCALE_LANGUAGES = ["en", "ru", "fr", "de", "it", "es", "pt", "zh", "ja", "ko"]

FAST_DOMAINS = [
    "ebay.com",
    "poshmark.com",
    "vestiairecollective.com",
    "rebag.com",
    "popchill.com",
    "yoogiscloset.com",
]
SLOW_DOMAINS = [
    "therealreal.com",
    "theluxurycloset.com",
    "jolicloset.com",
    "fashionphile.com",
]
SOLD_WITHOUT_PRICE_DOMAINS = ["yoogiscloset.com", "fashionphile.com"]

# --- fixed values: brands and categories ---------------------------------------------

BRAND_SLUGS = [
    "chanel", "gucci", "louis-vuitton", "louisvuitton", "lv", "hermes",
    "prada", "dior", "fendi", "balenciaga", "bottega-veneta", "bottegaveneta",
    "celine", "givenchy", "valentino", "ysl", "saint-laurent", "burberry",
    "chloe", "loewe", "versace", "dolce-gabbana", "miumiu", "cartier",
]
CATEGORY_SLUGS = [
    "bags", "handbags", "purses", "wallets", "accessories", "shoes",
    "clothing", "jewelry", "watches", "sunglasses", "belts", "scarves",
    "women", "men", "kids", "sale", "new-arrivals", "trending", "shop",
    "luxury", "vintage", "designer", "collections", "categories",
]
BRAND_ALIASES = {
    "christian dior": "dior",
    "louis vuitton": "louis vuitton",
    "louisvuitton": "louis vuitton",
    "lv": "louis vuitton",
    "l v": "louis vuitton",
    "saint laurent": "saint laurent",
    "ysl": "saint laurent",
    "bottega veneta": "bottega veneta",
    "bottegaveneta": "bottega veneta",
    "dolce gabbana": "dolce gabbana",
    "d and g": "dolce gabbana",
    "d g": "dolce gabbana",
    "miu miu": "miumiu",
}
BLOCKED_LISTING_SLUGS = ["christian-dior-black-leather-jeanne-handbag-695048979b2158e2f362c40a"]

# --- fixed values: titles ------------------------------------------------------------

TITLE_STOP_WORDS = [
    "bag", "bags", "handbag", "handbags", "women", "woman", "men", "man",
    "small", "medium", "large", "mini", "vintage", "authentic", "black",
    "brown", "white", "pink", "red", "blue", "green", "new", "used",
    "preloved", "with", "without", "and", "for", "the", "this", "that",
]
SOLD_URL_MARKERS = [
    "/sold/", "/completed/", "sold=true", "status=sold", "ended=",
    "sold-item", "completed-listing", "sold-listing",
]
SOLD_TITLE_MARKERS = ["sold listing", "ended listing", "completed listing", "no longer available"]
BLOCKED_TITLES = ["403 ERROR", "Sorry, you have been blocked", "Access Denied"]
BLOCKED_TITLE_MARKERS = [
    "access denied",
    "access to this page has been denied",
    "pardon the interruption",
    "just a moment",
    "checking your browser",
    "attention required",
    "request blocked",
    "px-captcha",
    "perimeterx",
]

# --- fixed values: money -------------------------------------------------------------

CURRENCY_ALIASES = {
    "$": "USD", "USD": "USD", "US$": "USD", "US $": "USD",
    "€": "EUR", "EUR": "EUR", "EURO": "EUR", "EUROS": "EUR",
    "£": "GBP", "GBP": "GBP", "GB £": "GBP",
    "¥": "JPY", "JPY": "JPY", "JP ¥": "JPY",
    "₽": "RUB", "RUB": "RUB", "RUR": "RUB",
    "CAD": "CAD", "CA$": "CAD", "C$": "CAD",
    "AUD": "AUD", "AU$": "AUD", "A$": "AUD",
    "CHF": "CHF",
    "CNY": "CNY", "CN¥": "CNY", "RMB": "CNY",
    "INR": "INR", "₹": "INR",
    "KRW": "KRW", "₩": "KRW",
    "MXN": "MXN", "MX$": "MXN",
    "BRL": "BRL", "R$": "BRL",
    "ZAR": "ZAR", "R": "ZAR",
    "TWD": "TWD", "NT$": "TWD", "NT": "TWD",
    "HKD": "HKD", "HK$": "HKD",
    "SGD": "SGD", "S$": "SGD",
}
PRICE_STOP_WORDS = [
    "shipping", "delivery", "tax", "fee", "discount", "sale", "save",
    "original", "was", "compare", "retail", "msrp", "list price",
    "estimated", "approx", "approximately", "starting at", "from",
    "per month", "per week", "per day", "per hour", "installment",
    "deposit", "down payment", "processing", "handling", "service",
    "convenience", "convenience fee", "transaction", "payment",
    "subscription", "membership", "renewal", "activation",
    "insurance", "warranty", "protection", "extended",
    "clearance", "closeout", "liquidation", "wholesale",
    "minimum", "maximum", "range", "between", "up to",
    "starting from", "as low as", "as high as",
    "refund", "return", "exchange", "credit",
]
MAX_PRICE = {
    "USD": 10000.0, "EUR": 9000.0, "GBP": 8000.0, "CAD": 13000.0, "AUD": 13000.0,
    "ZAR": 150000.0, "JPY": 1500000.0, "CNY": 70000.0, "INR": 800000.0,
    "KRW": 13000000.0, "TWD": 300000.0, "HKD": 80000.0, "SGD": 13000.0,
}
MIN_PRICE = {
    "USD": 5.0, "EUR": 5.0, "GBP": 5.0, "CAD": 5.0, "AUD": 5.0, "ZAR": 50.0,
    "JPY": 500.0, "CNY": 30.0, "INR": 300.0, "KRW": 5000.0, "TWD": 150.0,
    "HKD": 40.0, "SGD": 5.0,
}
DEFAULT_MAX_PRICE = 10000.0
DEFAULT_MIN_PRICE = 1.0

# --- fixed values: status and condition words ----------------------------------------

STATUS_BLOCKED = ["blocked", "proxy_auth_required", "access denied", "captcha"]
STATUS_SOLD = ["sold out", "sold", "out of stock", "unavailable", "ended", "нет в наличии", "продано"]
STATUS_AVAILABLE = ["available", "in stock", "buy now", "add to cart", "в продаже", "в наличии"]
STATUS_CATALOG = ["catalog", "каталог"]
STATUS_UNKNOWN = ["unknown", "неизвестно", "none", "null", "n/a"]
LISTING_SOLD = ["продано", "sold", "sold out", "out of stock", "unavailable", "ended", "нет в наличии"]

CONDITION_NOISE = [
    "more info", "more information", "view more", "show more", "details", "read more",
    "learn more", "mehr info", "mehr informationen", "weitere informationen", "piu info",
    "più info", "maggiori informazioni", "plus d'informations", "plus d informations",
    "condition info",
]
CONDITION_SCHEMA = {
    "NewCondition": "New",
    "UsedCondition": "Used",
    "RefurbishedCondition": "Refurbished",
    "DamagedCondition": "Damaged",
}
CONDITION_RU = {
    "новый": "New",
    "новое": "New",
    "новая": "New",
    "как новое": "Like new",
    "б/у": "Used",
    "бу": "Used",
    "отличное": "Excellent",
    "очень хорошее": "Very good",
    "хорошее": "Good",
    "удовлетворительное": "Fair",
    "плохое": "Poor",
}
CONDITION_DE = {
    "wie neu": "Like new",
    "neuwertig": "Like new",
    "neu": "New",
    "sehr guter zustand": "Very good",
    "sehr gut": "Very good",
    "guter zustand": "Good",
    "gut": "Good",
    "gebraucht": "Used",
    "akzeptabel": "Fair",
    "befriedigend": "Fair",
    "stark benutzt": "Worn",
}
CONDITION_EN = {
    "excellent condition": "Excellent condition",
    "very good condition": "Very good condition",
    "good condition": "Good condition",
    "fair condition": "Fair condition",
    "poor condition": "Poor condition",
    "like new": "Like new",
    "pre-loved": "Pre-loved",
    "preloved": "Pre-loved",
    "pre-owned": "Pre-owned",
    "pre owned": "Pre-owned",
    "gently used": "Gently used",
    "excellent": "Excellent",
    "very good": "Very good",
    "great condition": "Great condition",
    "good": "Good",
    "fair": "Fair",
    "poor": "Poor",
    "pristine": "Pristine",
    "mint": "Mint",
    "shows wear": "Shows wear",
    "worn": "Worn",
    "giftable": "Giftable",
    "flawed": "Flawed",
    "new": "New",
    "used": "Used",
}
CONDITION_BAD_MARKERS = [
    "add to cart", "buy now", "checkout", "sold out", "out of stock",
    "more info", "mehr info", "piu info", "più info",
]
CONDITION_GOOD_MARKERS = [
    "new", "like new", "excellent", "very good", "good", "fair", "poor", "used",
    "pre-owned", "pre owned", "pre-loved", "preloved", "gently used", "great condition",
    "vintage", "pristine", "mint", "shows wear", "worn", "giftable", "flawed",
    "zustand", "wie neu", "gebraucht", "sehr gut", "guter zustand",
]
# phrase patterns of a description, first hit wins
CONDITION_PHRASES = [
    (r"\b(brand\s+new|new\s+with\s+tags|new\s+without\s+tags|new\s+in\s+box|bnwt|nwt|never\s+worn|unworn|unused)\b", "New"),
    (r"\blike\s+new\b", "Like new"),
    (r"\bpre[- ]?loved\b", "Pre-loved"),
    (r"\bgently\s+used\b", "Gently used"),
    (r"\bpre[- ]?owned\b", "Pre-owned"),
    (r"\bexcellent\b", "Excellent"),
    (r"\bvery\s+good\b", "Very good"),
    (r"\bgreat\s+condition\b", "Great condition"),
    (r"\bgood\b", "Good"),
    (r"\bfair\b", "Fair"),
    (r"\bpoor\b", "Poor"),
    (r"\bused\b", "Used"),
]
TITLE_NEW_PATTERN = r"\b(brand\s+new|new\s+with\s+tags|new\s+in\s+box|bnwt|nwt|unworn)\b"
TITLE_USED_PATTERN = r"\b(pre[- ]?owned|used|second\s+hand|preloved|vintage)\b"
CONDITION_LABELS = "item\\s+condition|condition|condizione|etat|état|state|zustand|artikelzustand"
CONDITION_RANKS = {
    "A": "Mint",
    "AB": "Excellent",
    "B": "Gently used",
    "BC": "Used",
    "C": "Well used",
    "CD": "Very well used",
    "D": "Need repair",
    "S": "New",
    "SA": "Like new",
}
ENGLISH_CONDITION_WORDS = [
    "new", "brand", "excellent", "very", "good", "fair", "poor", "used", "pre", "owned",
    "preowned", "condition", "vintage", "mint", "like", "wear", "shows", "showing", "with",
    "without", "light", "minor", "visible", "signs", "sign", "of", "scratches", "scratch",
    "marks", "mark", "stains", "stain", "patina", "restored", "rare", "authentic", "unused",
    "pristine", "as", "is", "a", "an", "the", "well", "maintained", "flaws", "flaw",
    "outside", "inside",
]
DEFAULT_CONDITION = "Good Condition"
CONDITION_EMPTY = ["unknown", "n/a", "none", "null", "неизвестно"]
BADGE_SOLD = ["sold", "sold out", "out of stock", "продан", "продано", "нет в наличии"]
COUNTRY_ALIASES = {
    "usa": "US",
    "u.s.a.": "US",
    "u.s.": "US",
    "united states": "US",
    "united states of america": "US",
    "uk": "UK",
    "u.k.": "UK",
    "united kingdom": "UK",
    "great britain": "UK",
}

# --- fixed values: block pages and crawl errors --------------------------------------

VISIBLE_BLOCK_MARKERS = {
    "access_denied": [
        "access to this page has been denied",
        "sorry, you have been blocked",
        "you have been blocked",
        "request blocked",
        "forbidden",
        "access denied",
    ],
    "bot_challenge_text": [
        "before we continue",
        "press & hold to confirm you are",
        "press & hold",
        "verify you are human",
        "checking your browser",
        "just a moment",
        "attention required",
        "why have i been blocked",
        "unusual traffic",
        "security check",
    ],
    "js_block_page": [
        "please enable js and disable any ad blocker",
        "please enable javascript and disable any ad blocker",
        "enable javascript and cookies to continue",
    ],
}
RAW_BLOCK_MARKERS = {
    "perimeterx": [
        "px-captcha",
        "captcha.px-cloud.net",
        "window._pxappid",
        "window._pxuuid",
        "perimeterx",
    ],
    "datadome": [
        "captcha-delivery.com",
        "geo.captcha-delivery.com",
        "ct.captcha-delivery.com",
        "datadome",
    ],
}
SOFT_BLOCK_MARKERS = {
    "enable_js": ["enable javascript", "javascript is disabled", "please enable javascript"],
    "cookie_wall": ["accept cookies", "cookie consent", "enable cookies", "manage cookies"],
}
CHALLENGE_SCRIPT_MARKERS = ["/cdn-cgi/challenge-platform/", "cf-chl-", "challenge-platform/scripts/jsd"]
CHALLENGE_TEXT_MARKERS = [
    "attention required",
    "just a moment",
    "checking your browser",
    "verify you are human",
    "before we continue",
    "captcha",
]
PROXY_STATUSES = ["proxy_error", "proxy_auth_required"]
TRANSPORT_STATUSES = ["transport_error", "connection_error", "error", "failed"]
PROXY_ERROR_TOKENS = [
    "proxy", "tunnel", "407", "err_tunnel_connection_failed", "proxyconnect", "socks",
    "proxy auth", "proxy authentication",
]
SOFT_ERROR_TOKENS = ["proxy blocked", "playwright: blocked"]
HARD_ERROR_TOKENS = ["403", "429", "blocked", "access denied", "cloudflare", "captcha", "challenge"]
NETWORK_ERROR_TOKENS = [
    "timeout", "timed out", "read timed out", "remote end closed", "connection reset",
    "connectionerror", "connection aborted", "proxyerror", "transport:",
]
CRITICAL_ERROR_TOKENS = [
    "407", "proxy_auth", "authentication", "err_tunnel", "tunnel connection", "connection refused",
]

# --- fixed values: broken text -------------------------------------------------------

MOJIBAKE_PATTERN = "(?:рџ|вњ|вљ|в†|пёЏ)"
MOJIBAKE_CHARS = (
    "Ѓѓ‚…†‡€‰Љ‹ЊЋЏђ"
    "‘’“”•–—™љ›њћџЎ"
    "ўЈ¤Ґ¦§Ё©Є«¬®Ї°"
    "±Ііґµ¶·ё№є»јЅѕї"
)
DISPLAY_MARKERS = (
    "✓✗✅⚠️❌→↷ℹ\U0001f4ca\U0001f4c4\U0001f517"
    "\U0001f916\U0001f5d1\U0001f9f9\U0001f4e1\U0001f4a1\U0001f4be"
)

# --- fixed values: results -----------------------------------------------------------

TRANSIENT_RESULT_FIELDS = [
    "saved_to", "report_file", "report_filename", "report_format", "report_file_url",
    "report_url", "report_task_id", "report_status", "report_ready", "report_error",
    "avito_price_original", "avito_currency_original", "avito_price_usd",
    "avito_price_error", "cached", "cache_age",
]
TASK_STATUS = {
    "queued": "queued",
    "scheduled": "queued",
    "deferred": "queued",
    "started": "running",
    "finished": "ready",
    "failed": "failed",
    "stopped": "failed",
    "canceled": "failed",
}

# --- fixed values: urls and reject reasons -------------------------------------------

TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src"]
CATALOG_BRANDS = ["chanel", "gucci", "louis-vuitton", "prada", "dior", "hermes"]
CATALOG_CATEGORIES = ["bags", "handbags", "women", "men", "shoes", "accessories"]
CATALOG_TEXT = {
    "brand": "заканчивается на бренд '%s'",
    "category": "заканчивается на категорию '%s'",
    "short": "короткий путь (%d уровня)",
    "no_id": "не содержит ID товара",
}
REASON_TEXT = {
    "clip_below_threshold": "итоговая схожесть ниже порога (итоговая %.1f%%, CLIP %.1f%%, порог %.0f%%)",
    "phash_penalty_final_below": (
        "схожесть после штрафа pHash ниже порога (итоговая %.1f%%, CLIP %.1f%%, pHash %s, порог %.0f%%)"
    ),
    "color_mismatch": "не совпал цвет (%s, порог %.0f%%)",
    "phash_mismatch": "PHASH не прошел (distance %s, порог %d)",
    "catalog_page": "каталог/категория (не страница товара)",
    "unsupported_domain": "неподдерживаемый домен",
    "shape_gate_mismatch": "не совпал силуэт модели",
    "brand_gate_mismatch": "не совпал бренд",
    "sold_item": "товар продан",
}
OTHER_REASON_TEXT = "отфильтровано (%s)"

# --- fixed values: site title clean-up -----------------------------------------------

EBAY_GENERIC_TITLES = [
    "ebay", "home", "shop by category", "all categories", "seller's other items",
    "clothing, shoes & accessories", "women", "men", "collectibles", "jewelry & watches",
    "sports mem, cards & fan shop", "women's bags & handbags",
]
EBAY_BAD_TITLE_MARKERS = ["service unavailable", "access denied", "blocked", "captcha"]
REALREAL_GENERIC_TITLES = ["the realreal", "home"]
REALREAL_PROMO_MARKERS = ["site credit", "first purchase", "sign in", "join now", "shop now"]
POSHMARK_GENERIC_TITLES = ["home", "poshmark", "shop"]
EMPTY_MARKERS = ["", "unknown", "none", "null", "n/a", "na"]
MAX_REASONABLE_PRICE = 1000000.0
ASKING_PRICE_ERROR = "не удалось распознать цену avito"

# --- fixed values: page text ---------------------------------------------------------

STOP_MARKERS = ["you may also like", "recently viewed", "similar items", "more from"]
PROMO_PRICE_TOKENS = [
    "site credit", "est. retail", "estimated retail", "price was", "you save", "save ", "klarna", "afterpay",
]

# --- fixed values: embedded JSON -----------------------------------------------------

CURRENCY_KEYS = ("priceCurrency", "currency", "currencyCode", "currency_code", "price_currency")
PRICE_KEYS = (
    "finalPrice", "salePrice", "sellingPrice", "currentPrice", "newProductPrice", "newPrice",
    "displayPrice", "productPrice", "discountedPrice", "regularPrice", "priceValue", "price",
    "lowPrice", "highPrice", "price_amount", "amount",
)
IDENTITY_KEYS = (
    "id", "productId", "productID", "itemId", "product_id", "sku", "itemCode", "productCode", "slug", "url",
    "canonicalUrl", "canonicalURL", "canonical_url", "href", "path", "productUrl", "handle", "link",
)
STATE_NAMES = ["__PRELOADED_STATE__", "__INITIAL_STATE__", "__NEXT_DATA__", "productJson", "_oa"]
