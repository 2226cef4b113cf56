"""Queries: streams over the events table, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import crawl, logs
from ..streaming.run import run_available, shared_dir
from .fixtures import FIXTURES, load
from .registry import cte, query


def event_stream(spark, d, name, closing=False):
    """A derived event table as a stream of the events files.

    With ``closing`` one event of the far future joins the stream: it moves the watermark
    past all others, so every window of theirs is closed, while its own stays open and
    out of the result.
    """
    events = load(spark, d, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{d}/events*.parquet")
    if closing:
        last = {"event_id": F.lit(0), "user_id": F.lit(0), "ts": F.lit("2200-01-01 00:00:00"), "event_type": F.lit("error")}
        row = spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
        path = shared_dir(spark)
        row.write.parquet(path)
        source = source.unionByName(spark.readStream.schema(events.schema).parquet(path))
    return spark.sql(FIXTURES[name], events=source)


def _exact(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", crawl.ROCKSDB)


@query(
    "log_metrics_stream",
    """SELECT start_at, event, level, domain, count(*) AS n FROM (SELECT *, epoch_us(ts) // 60000000 * 60000000 AS start_at FROM @log_events) GROUP BY 1, 2, 3, 4""",
)
def log_metrics_stream(spark, d):
    out = run_available(logs.log_metrics_stream(event_stream(spark, d, "log_events", closing=True)), shared_dir(spark))
    return out.select(F.unix_micros("from").alias("start_at"), "event", "level", "domain", "n")


@query(
    "dedupe_stream",
    "SELECT DISTINCT image_hash FROM (SELECT CAST(event_id % 500 AS VARCHAR) AS image_hash FROM {events})",
)
def dedupe_stream(spark, d):
    events = event_stream(spark, d, "log_events").select("ts", (F.col("event_id") % 500).cast("string").alias("image_hash"))
    # one file is one batch, so the table's whole month counts as one cache period here
    out = run_available(logs.dedupe_stream(events, 40 * 86400), shared_dir(spark))
    return out.select("image_hash")


@query(
    "soft_block_stream",
    """WITH b AS (SELECT domain, epoch_us(ts) AS u FROM @classed WHERE class IN ('soft_block', 'hard_block')),
        w AS (SELECT domain, (u // 60000000 - k) * 60000000 AS s FROM b, range(0, 60) AS r(k))
        SELECT domain, s AS start_at, count(*) AS hits FROM w GROUP BY 1, 2
        HAVING count(*) >= 2""",
)
def soft_block_stream(spark, d):
    alerts = crawl.soft_block_stream(event_stream(spark, d, "crawl_events", closing=True), window_sec=3600, slide_sec=60)
    out = run_available(alerts, shared_dir(spark))
    return out.select("domain", F.unix_micros("from").alias("start_at"), "hits")


@query(
    "soft_block_holds",
    """WITH b AS (SELECT *, epoch_us(ts) AS u FROM @classed WHERE class IN ('soft_block', 'hard_block')),
        h AS (SELECT *, count(*) OVER (PARTITION BY domain ORDER BY u RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS hits FROM b)
        SELECT event_id, hits, max(CASE WHEN hits >= 2 THEN u END) OVER (PARTITION BY domain ORDER BY u RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW)
          + 1800000000 AS hold_until FROM h""",
)
def soft_block_holds(spark, d):
    _exact(spark)
    held = crawl.soft_block_holds(event_stream(spark, d, "crawl_events", closing=True), window_sec=3600, hold_sec=1800)
    return run_available(held, shared_dir(spark)).select("event_id", "hits", "hold_until")


cte(
    "quarantined",
    """SELECT event_id, streak, CASE WHEN until > u THEN until END AS hold_until FROM (
        SELECT *, max(CASE WHEN class IN ('soft_block', 'hard_block') THEN u + 36000000000 WHEN class = 'network' AND streak >= 2 THEN u + 18000000000 END)
            OVER (PARTITION BY proxy, domain, g ORDER BY u, event_id) AS until FROM (
        SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY proxy, domain, g ORDER BY u, event_id) AS BIGINT) AS streak FROM (
        SELECT *, epoch_us(ts) AS u, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY proxy, domain ORDER BY ts, event_id) AS g FROM @classed WHERE proxy_type = 'rotating')))""",
)


@query("quarantine_stream", "SELECT event_id, streak, hold_until FROM @quarantined")
def quarantine_stream(spark, d):
    _exact(spark)
    states = crawl.quarantine_stream(event_stream(spark, d, "crawl_events", closing=True), block_sec=36000, network_sec=18000)
    return run_available(states, shared_dir(spark)).select("event_id", "streak", "hold_until")


@query("quarantine_states", "SELECT event_id, streak, hold_until FROM @quarantined")
def quarantine_states(spark, d):
    from .fixtures import fixture

    out = crawl.quarantine_states(fixture(spark, d, "crawl_events"), block_sec=36000, network_sec=18000)
    return out.select("event_id", "streak", "hold_until")
