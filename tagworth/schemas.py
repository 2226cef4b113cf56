"""Schemas of the tables that enter and leave the library."""

from __future__ import annotations

SEARCH_ITEM = (
    "struct<link:string,source:string,thumbnail:string,image:string,title:string,"
    "price:string,extracted_price:string,price_with_symbol:string,price_str:string>"
)
SECTIONS = ("exact_matches", "visual_matches", "organic_results", "shopping_results")
SEARCH_PAYLOAD = "struct<" + ",".join(f"{s}:array<{SEARCH_ITEM}>" for s in SECTIONS) + ">"

LISTING = "struct<title:string,price:double,currency:string,status:string,condition:string,country:string>"

EVENT_LOG = (
    "ts timestamp, level string, logger string, event string, msg string, trace string, "
    "domain string, url string, stage string, seconds double"
)
CRAWL_EVENT = "event_id bigint, ts timestamp, proxy string, proxy_type string, domain string, ok boolean, error string"
SNAPSHOT = "image_hash string, written_at timestamp, payload string"
TASK_EVENT = "task_id string, raw_status string, ts timestamp"
