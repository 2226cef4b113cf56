"""Queries: sources and scalars that others use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as h
from ..functions import money, objects as o
from ..functions import similarity as sim
from ..operators import extract as e
from ..sources import logs, pages, snapshots
from ..streaming.run import shared_dir
from .fixtures import fixture, load
from .registry import query, rnd


@query("read_pages", "SELECT page_id, md5(url) AS url, md5(html) AS html, length(html) AS chars FROM {pages}")
def read_pages(spark, d):
    rows = pages.read_pages(spark, f"{d}/pages.parquet")
    return rows.select("page_id", F.md5("url").alias("url"), F.md5("html").alias("html"), F.length("html").cast("long").alias("chars"))


@query("read_event_log", "SELECT epoch_us(ts) // 1000 AS at, event, level, domain, trace, stage, seconds FROM @log_events")
def read_event_log(spark, d):
    """Events written as JSON lines and read by their schema, times to the millisecond."""
    path = shared_dir(spark)
    rows = fixture(spark, d, "log_events").select("ts", "level", "event", "trace", "domain", "stage", "seconds")
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    back = logs.read_event_log(spark, path)
    return back.select(F.unix_millis("ts").alias("at"), "event", "level", "domain", "trace", "stage", "seconds")


@query("snapshot_cache", "SELECT CAST(user_id AS VARCHAR) AS image_hash, epoch_us(ts) AS at, CAST(event_id AS VARCHAR) AS payload, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM {events}")
def snapshot_cache(spark, d):
    """Snapshots stored without their transient fields, by day, and read again."""
    path = shared_dir(spark)
    rows = load(spark, d, "events").select(
        F.col("user_id").cast("string").alias("image_hash"), F.col("ts").cast("timestamp").alias("written_at"),
        F.col("event_id").cast("string").alias("payload"), F.lit(True).alias("cached"), F.lit(1).alias("cache_age"),
    )
    snapshots.write_snapshots(rows, path)
    back = snapshots.read_snapshots(spark, path)
    return back.select("image_hash", F.unix_micros("written_at").alias("at"), "payload", F.col("day").cast("string").alias("day"))


@query(
    "hu_log",
    f"""SELECT vec_id, i AS place, {rnd("-sign(v) * log10(abs(v))", 6)} AS scaled FROM (
        SELECT vec_id, i, CASE WHEN e[i] = 0 THEN 1e-12 ELSE e[i] END AS v FROM (
        SELECT vec_id, unnest(range(1, 8)) AS i, CAST(embedding AS DOUBLE[]) AS e FROM {{embeddings}}) x) y""",
)
def hu_log(spark, d):
    moments = F.transform(F.slice("embedding", 1, 7), lambda v: v.cast("double"))
    rows = load(spark, d, "embeddings").select("vec_id", F.posexplode(sim.hu_log(moments)).alias("i", "v"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("place"), F.round("v", 6).alias("scaled"))


@query(
    "currency_words",
    """SELECT text_id, CASE CAST(text_id % 4 AS INT) WHEN 0 THEN CAST(whole AS VARCHAR) || ' RUB' WHEN 1 THEN CAST(whole AS VARCHAR) || ' USD'
        WHEN 2 THEN CAST(whole AS VARCHAR) || ' eur' ELSE '' END AS shown FROM @price_texts""",
)
def currency_words(spark, d):
    shown = F.col("whole").cast("string")
    words = F.when(F.col("text_id") % 4 == 0, F.concat(shown, F.lit(" руб"))).when(F.col("text_id") % 4 == 1, F.concat(shown, F.lit(" долларов"))).when(
        F.col("text_id") % 4 == 2, F.concat(F.lit(" "), shown, F.lit(" eur "))
    )
    return fixture(spark, d, "price_texts").select("text_id", money.currency_words(words).alias("shown"))


@query(
    "price_universal",
    """SELECT page_id, CASE WHEN kind IN (0, 3) THEN CAST(price AS DOUBLE) END AS price,
        CASE kind WHEN 0 THEN 'EUR' WHEN 3 THEN 'USD' END AS currency FROM @listing_pages""",
)
def price_universal(spark, d):
    """Structured data first, then scripts, then texts with a symbol."""
    rows = fixture(spark, d, "listing_pages").withColumns(
        {"lines": h.text_lines("html"), "ld": o.price_from_objects(o.json_objects(h.jsonld_texts("html"))), "scripts": h.scripts("html")}
    )
    return rows.select("page_id", e.price_universal(F.col("lines"), F.col("ld"), F.col("scripts"), F.col("html")).alias("p")).select("page_id", "p.price", "p.currency")
