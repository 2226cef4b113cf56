"""Queries: crawl health, audits, reports, snapshots, results and page lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions.status import status_norm
from ..operators import audit, crawl, page_lines, pricing, report, routing
from ..operators.candidates import cap_per_domain
from ..sources import fx, items_api, results, snapshots
from .fixtures import fixture, load
from .q_pricing import items
from .registry import any_like, cte, query, rnd

cte(
    "classed",
    """SELECT *, CASE WHEN error IS NULL THEN NULL WHEN error LIKE 'Proxy blocked%' THEN 'soft_block' WHEN error LIKE 'HTTP 403%' THEN 'hard_block'
        WHEN error LIKE 'Read%' THEN 'network' ELSE 'critical_proxy' END AS class FROM @crawl_events""",
)


@query("error_class", "SELECT event_id, class FROM @classed")
def error_class(spark, d):
    return fixture(spark, d, "crawl_events").select("event_id", crawl.error_class("error").alias("class"))


@query(
    "is_proxy_failure",
    """SELECT event_id, coalesce(domain_no = 0, FALSE) OR (domain_no IN (1, 2) AND coalesce(error LIKE 'Proxy%' OR error LIKE '407%', FALSE)) AS proxy_failure FROM @crawl_events""",
)
def is_proxy_failure(spark, d):
    status = F.when(F.col("domain_no") == 0, F.lit("proxy_error")).when(F.col("domain_no") < 3, F.lit("error")).otherwise(F.lit("blocked"))
    return fixture(spark, d, "crawl_events").select("event_id", crawl.is_proxy_failure(status, "error").alias("proxy_failure"))


@query(
    "soft_block_flags",
    """WITH b AS (SELECT *, epoch_us(ts) AS u FROM @classed WHERE class IN ('soft_block', 'hard_block')),
        h AS (SELECT *, count(*) OVER (PARTITION BY domain ORDER BY u RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS hits FROM b)
        SELECT event_id, hits, max(CASE WHEN hits >= 2 THEN u END) OVER (PARTITION BY domain ORDER BY u RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW)
          + 1800000000 AS hold_until FROM h""",
)
def soft_block_flags(spark, d):
    out = crawl.soft_block_flags(fixture(spark, d, "crawl_events"), window_sec=3600, hold_sec=1800)
    return out.select("event_id", "hits", F.unix_micros("hold_until").alias("hold_until"))


@query(
    "failure_streaks",
    """WITH g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY proxy ORDER BY ts, event_id) AS grp FROM @classed),
        s AS (SELECT *, CAST(sum(CASE WHEN NOT ok AND class <> 'soft_block' THEN 1 ELSE 0 END) OVER (PARTITION BY proxy, grp ORDER BY ts, event_id) AS BIGINT) AS streak FROM g)
        SELECT event_id, streak, streak >= CASE proxy_type WHEN 'rotating' THEN 3 ELSE 2 END
          OR (proxy_type = 'rotating' AND count(*) FILTER (NOT ok AND class = 'critical_proxy') OVER (PARTITION BY proxy, grp ORDER BY ts, event_id) > 0) AS is_bad FROM s""",
)
def failure_streaks(spark, d):
    return crawl.failure_streaks(fixture(spark, d, "crawl_events")).select("event_id", "streak", "is_bad")


@query(
    "crawl_health",
    """SELECT proxy, domain, count(*) AS total, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (class = 'soft_block') AS soft_block,
        count(*) FILTER (class = 'hard_block') AS hard_block, count(*) FILTER (class = 'network') AS network,
        count(*) FILTER (class = 'critical_proxy') AS critical_proxy, arg_max(ok, (ts, event_id)) AS last_ok FROM @classed GROUP BY 1, 2""",
)
def crawl_health(spark, d):
    return crawl.crawl_health(fixture(spark, d, "crawl_events")).drop("last_ts", "in_flight")


@query("count_by_domain", "SELECT analysis_id, domain, count(*) AS n FROM @listings GROUP BY 1, 2")
def count_by_domain(spark, d):
    return audit.count_by(fixture(spark, d, "listings"), "domain")


@query("count_by_source", "SELECT analysis_id, serp_source, count(*) AS n FROM @listings GROUP BY 1, 2")
def count_by_source(spark, d):
    return audit.count_by(fixture(spark, d, "listings"), "serp_source")


def _rejected(spark, d):
    cands = fixture(spark, d, "cands")
    return routing.route_candidates(cands, routing.infer_brand(cands))[1]


@query(
    "reject_counts",
    """SELECT analysis_id, count(*) FILTER (reason_code = 'catalog_page') AS catalog_page,
        count(*) FILTER (reason_code = 'unsupported_domain') AS unsupported_domain FROM @routed WHERE reason_code IS NOT NULL GROUP BY 1""",
)
def reject_counts(spark, d):
    out = audit.reject_counts(_rejected(spark, d))
    pick = lambda k: F.coalesce(F.try_element_at("reject_reason_counts", F.lit(k)), F.lit(0)).alias(k)
    return out.select("analysis_id", pick("catalog_page"), pick("unsupported_domain"))


@query(
    "run_counters",
    """SELECT analysis_id, (SELECT count(*) FROM @domain_ranked k WHERE k.analysis_id = i.analysis_id AND dr <= 3) AS kept_total,
        count(*) AS final_items, count(*) FILTER (price > 0) AS prices_found, count(*) FILTER (status = 'Blocked') AS blocked_items,
        (SELECT count(*) FROM @routed r WHERE r.analysis_id = i.analysis_id AND reason_code IS NOT NULL) AS rejected_total,
        (SELECT CAST(sum(clamped_low_count + clamped_high_count) AS BIGINT) FROM @tiers t WHERE t.analysis_id = i.analysis_id) AS clamped_prices
        FROM @items i GROUP BY 1""",
)
def run_counters(spark, d):
    rows = items(spark, d)
    kept = cap_per_domain(fixture(spark, d, "cands"), 3)
    return audit.pipeline_stats(kept, rows, _rejected(spark, d), pricing.market_prices(rows))


@query(
    "parse_coverage",
    f"""SELECT site, count(*) AS pages, {rnd('avg(CASE WHEN title IS NULL THEN 0 ELSE 1 END)', 4)} AS with_title,
        {rnd('avg(CASE WHEN page_price IS NULL THEN 0 ELSE 1 END)', 4)} AS with_price,
        {rnd('avg(CASE WHEN status IS NULL THEN 0 ELSE 1 END)', 4)} AS with_status,
        {rnd("avg(CASE WHEN coalesce(condition, '') = '' THEN 0 ELSE 1 END)", 4)} AS with_condition FROM (SELECT *, domain AS site FROM @parsed) GROUP BY 1""",
)
def parse_coverage(spark, d):
    rows = fixture(spark, d, "parsed").withColumnsRenamed({"page_price": "price", "domain": "site"})
    return audit.parse_coverage(rows)


@query(
    "stage_breakdown",
    f"""SELECT trace, stage, {rnd('s', 4)} AS seconds, {rnd('s / sum(s) OVER (PARTITION BY trace) * 100', 4)} AS percent FROM (
        SELECT trace, stage, sum(seconds) AS s FROM @log_events GROUP BY 1, 2)""",
)
def stage_breakdown(spark, d):
    out = audit.stage_breakdown(fixture(spark, d, "log_events"))
    return out.select("trace", "stage", F.round("seconds", 4).alias("seconds"), F.round("percent", 4).alias("percent"))


@query(
    "task_status",
    """SELECT task_id, raw_status, CASE raw_status WHEN 'queued' THEN 'queued' WHEN 'started' THEN 'running' WHEN 'finished' THEN 'ready'
        WHEN 'failed' THEN 'failed' ELSE 'unknown' END AS status, raw_status = 'finished' AS report_ready FROM (
        SELECT task_id, arg_max(raw_status, (ts, seq)) AS raw_status FROM @tasks GROUP BY 1)""",
)
def task_status(spark, d):
    return audit.task_status(fixture(spark, d, "tasks")).drop("ts")


@query(
    "task_states_for",
    """SELECT i.task_id, coalesce(CASE raw_status WHEN 'queued' THEN 'queued' WHEN 'started' THEN 'running' WHEN 'finished' THEN 'ready'
        WHEN 'failed' THEN 'failed' WHEN 'lost' THEN 'unknown' END, 'not_found') AS status
        FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'new-' ELSE '' END || CAST(c_custkey AS VARCHAR) AS task_id FROM {customer}) i
        LEFT JOIN (SELECT task_id, arg_max(raw_status, (ts, seq)) AS raw_status FROM @tasks GROUP BY 1) t ON t.task_id = i.task_id""",
)
def task_states_for(spark, d):
    key = F.col("c_custkey").cast("string")
    ids = load(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("new-"), key)).otherwise(key).alias("task_id"))
    return audit.task_states_for(ids, fixture(spark, d, "tasks")).select("task_id", "status")


def _money(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'N/A' ELSE CAST(CAST(trunc({expr}) AS BIGINT) AS VARCHAR) || ' USD' END"


cte(
    "headline",
    f"""SELECT i.analysis_id, any_value(i.n) AS n, max(m.market_price_usd) FILTER (m.status_kind = 'available') AS av,
        max(m.market_price_usd) FILTER (m.status_kind = 'sold') AS so, any_value(i.raw) AS raw
        FROM (SELECT analysis_id, count(*) AS n, {rnd('median(price) FILTER (price > 0)')} AS raw FROM @items GROUP BY 1) i
        LEFT JOIN @market m USING (analysis_id) GROUP BY 1""",
)


@query(
    "report_summary",
    f"""SELECT analysis_id, CAST(k AS INT) AS line_no, CASE k WHEN 1 THEN 'Avito original price' WHEN 2 THEN 'Avito price in USD' WHEN 3 THEN 'Final median'
          WHEN 4 THEN 'Available median' WHEN 5 THEN 'Sold median' WHEN 6 THEN 'All median' ELSE 'Cards total' END AS label,
        CASE k WHEN 1 THEN 'N/A' WHEN 2 THEN 'N/A' WHEN 3 THEN {_money('coalesce(av, so, raw)')} WHEN 4 THEN {_money('av')} WHEN 5 THEN {_money('so')}
          WHEN 6 THEN {_money('raw')} ELSE CAST(n AS VARCHAR) END AS value FROM @headline, range(1, 8) AS r(k)""",
)
def report_summary(spark, d):
    rows = items(spark, d)
    cards = rows.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("cards_total"))
    return report.report_summary(pricing.headline_price(rows).join(cards, "analysis_id"))


@query(
    "report_cards",
    f"""SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY pos, price_original) AS card_no, replace(title, '&', '&amp;') AS title, site,
        CASE WHEN price IS NULL THEN 'No price' WHEN status = 'Sold' THEN 'Sold' ELSE 'Available' END AS badge,
        CASE WHEN partkey % 2 = 0 THEN 'used' ELSE '{fixed.DEFAULT_CONDITION}' END AS condition, printf('%.1f%%', discount * 100) AS similarity, {_money('price')} AS price_usd,
        CAST(CAST(trunc(price_original) AS BIGINT) AS VARCHAR) || ' ' || currency_original AS price_original, url AS source_url FROM @items""",
)
def report_cards(spark, d):
    rows = items(spark, d).withColumns(
        {"condition": F.when(F.col("partkey") % 2 == 0, F.lit("used")).otherwise(F.lit("n/a")), "similarity": F.col("discount")}
    )
    out = report.report_cards(rows, [F.col("pos"), F.col("price_original")])
    return out.withColumn("card_no", F.col("card_no").cast("long"))


cte(
    "snaps",
    "SELECT CAST(user_id AS VARCHAR) AS image_hash, ts AS written_at, CAST(event_id AS VARCHAR) AS payload FROM {events}",
)


@query(
    "fresh_snapshots",
    """SELECT image_hash, arg_max(payload, written_at) AS payload, TRUE AS cached, CAST(min((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(written_at)) // 1000000) AS BIGINT) AS cache_age
        FROM @snaps WHERE epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(written_at) <= 86400000000 AND written_at <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1""",
)
def fresh_snapshots(spark, d):
    rows = load(spark, d, "events").select(
        F.col("user_id").cast("string").alias("image_hash"), F.col("ts").cast("timestamp").alias("written_at"), F.col("event_id").cast("string").alias("payload")
    )
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return snapshots.fresh_snapshots(rows, now)


@query(
    "item_lists",
    """SELECT analysis_id, CAST(floor((rn - 1) / 1000) AS INT) AS part, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (
        SELECT analysis_id, pos, row_number() OVER (PARTITION BY analysis_id ORDER BY pos) AS rn FROM @listings) GROUP BY 1, 2""",
)
def item_lists(spark, d):
    out = results.item_lists(fixture(spark, d, "listings").select("analysis_id", "pos", "url", "title"), lead=F.col("pos"))
    return out.select(
        "analysis_id", "part", F.size("items").cast("long").alias("n"),
        F.get("items", F.lit(0))["pos"].alias("first_pos"), F.element_at("items", -1)["pos"].alias("last_pos"),
    )


@query(
    "nested_results",
    """WITH r AS (SELECT analysis_id, pos, status, row_number() OVER (PARTITION BY analysis_id ORDER BY pos) AS rn FROM @listings),
        h AS (SELECT analysis_id, count(*) AS cards_total, count(*) AS n_items, count(*) FILTER (WHERE status = 'Sold') AS n_filtered_items FROM r GROUP BY 1),
        p AS (SELECT analysis_id, CAST(floor((rn - 1) / 1000) AS INT) AS part, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM r GROUP BY 1, 2)
        SELECT * FROM h JOIN p USING (analysis_id)""",
)
def nested_results(spark, d):
    """Headlines with every item, in the parts of the item table."""
    rows = fixture(spark, d, "listings").select("analysis_id", "pos", "url", "title", F.col("price_original").alias("price"), "status")
    head = rows.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("cards_total"))
    sold = rows.where("status = 'Sold'").select("analysis_id", "url", F.lit("sold").alias("reason_code"))
    headline = results.nested_results(head, rows, sold, lead=F.col("pos")).select("analysis_id", "cards_total", "n_items", "n_filtered_items")
    return headline.join(results.item_lists(rows, lead=F.col("pos")), "analysis_id").select(
        "analysis_id", "cards_total", "n_items", "n_filtered_items", "part", F.size("items").cast("long").alias("n"),
        F.get("items", F.lit(0))["pos"].alias("first_pos"), F.element_at("items", -1)["pos"].alias("last_pos"),
    )


@query(
    "fx_rates",
    "SELECT 'USD' AS base, code, rate FROM (SELECT DISTINCT n_name AS code, CAST(n_nationkey AS DOUBLE) + 0.5 AS rate FROM {nation})",
)
def fx_rates(spark, d):
    pairs = load(spark, d, "nation").agg(
        F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey") + F.lit(0.5)))).alias("conversion_rates")
    )
    payload = pairs.select(F.to_json(F.struct(F.lit("USD").alias("base_code"), "conversion_rates")).alias("payload"))
    return fx.read_fx_rates(payload)


@query(
    "item_records",
    """SELECT o_orderkey AS item_id, 'bag ' || o_orderkey AS title, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'GBP' ELSE 'USD' END AS currency,
        CASE WHEN o_orderstatus = 'F' OR o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 'Sold' ELSE 'Available' END AS status, 'GB' AS country FROM {orders}""",
)
def item_records(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    money = lambda cur: F.struct(F.col("o_totalprice").cast("string").alias("value"), F.lit(cur).alias("currency"))
    record = F.struct(
        F.concat(F.lit("bag "), "o_orderkey").alias("title"),
        F.when(k == 1, money("gbp")).when(k == 0, F.struct(F.lit("0").alias("value"), F.lit("USD").alias("currency"))).alias("price"),
        F.when(k > 1, money(None)).alias("minimumBidPrice"),
        F.struct(F.when(F.col("o_orderstatus") == "F", F.lit("OUT_OF_STOCK")).otherwise(F.lit("IN_STOCK")).alias("availabilityStatus")).alias("availability"),
        F.struct(F.lit("GB").alias("country")).alias("itemLocation"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("itemEndDate"),
    )
    rows = o.select(F.col("o_orderkey").alias("item_id"), F.to_json(record).alias("payload"))
    out = items_api.read_item_records(rows, now=F.lit("1997-01-01T00:00:00Z").cast("timestamp"))
    return out.drop("condition")


# --- lines of a page --------------------------------------------------------------------

cte("lines", "SELECT page_id, string_split(html, '<p>') AS ls, list_transform(string_split(html, '<p>'), lambda s: lower(s)) AS low FROM {pages}")
cte(
    "anchored",
    "SELECT *, CASE WHEN list_position(list_transform(low, lambda s: contains(s, '<br>')), TRUE) IS NULL THEN least(len(ls) - 1, 120) ELSE list_position(list_transform(low, lambda s: contains(s, '<br>')), TRUE) - 1 END AS anchor FROM @lines",
)


def _lines():
    return F.split("html", "<p>")


@query(
    "near_anchor",
    "SELECT page_id, md5(array_to_string(ls[greatest(0, anchor - 3) + 1:least(len(ls), anchor + 2)], '|')) AS near FROM @anchored",
)
def near_anchor(spark, d):
    near = page_lines.near_anchor(_lines(), "<br>", 3, 2)
    return load(spark, d, "pages").select("page_id", F.md5(F.array_join(near, "|")).alias("near"))


@query(
    "before_marker",
    """SELECT page_id, CASE WHEN p IS NULL THEN len(ls) ELSE p - 1 END AS kept FROM (
        SELECT *, list_position(list_transform(low, lambda s: contains(s, '<br>') OR contains(s, 'xyz')), TRUE) AS p FROM @lines)""",
)
def before_marker(spark, d):
    return load(spark, d, "pages").select("page_id", F.size(page_lines.before_marker(_lines(), ["<br>", "xyz"])).cast("long").alias("kept"))


@query(
    "label_next_line",
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST(page_id + 1 AS DOUBLE) END AS price, CASE WHEN page_id % 2 = 0 THEN 'USD' END AS currency FROM {pages}",
)
def label_next_line(spark, d):
    label = F.when(F.col("page_id") % 2 == 0, F.lit("* Price *")).otherwise(F.lit("Price was"))
    lines = F.concat(F.array(label, F.concat(F.lit("$"), F.col("page_id") + 1)), F.transform(_lines(), lambda s: F.lit("text")))
    return load(spark, d, "pages").select("page_id", page_lines.label_next_line(lines).alias("p")).select("page_id", "p.*")
