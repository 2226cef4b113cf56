"""Inputs at which earlier versions cut data short, stopped, or gave a wrong answer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tagworth.functions import objects as o
from tagworth.operators import crawl, extract, routing, titles
from tagworth.sources import snapshots
from tagworth.streaming.crawl import quarantine_states


def candidates(spark, titled):
    rows = [("a", 0, k, f"https://x.com/{k}", t, "visual_matches") for k, t in enumerate(titled)]
    return spark.createDataFrame(rows, "analysis_id string, section_rank int, pos int, url string, title string, serp_source string")


def test_all_titles_count(spark):
    df = candidates(spark, ["rare first word"] * 250 + ["common later phrase"] * 300)
    assert titles.keyword_profile(df, 2).first()["keywords"] == ["common later", "later phrase"]
    assert titles.keyword_profile(df, 2, pool=220).first()["keywords"] == ["rare first", "first word"]
    brands = spark.createDataFrame([("a", None)], "analysis_id string, target_brand string")
    best = titles.frequency_select(df, brands, 1).first()
    assert best["title"] == "common later phrase" and best["title_score"] == 903


def test_all_candidates_vote(spark):
    df = candidates(spark, ["Gucci bag"] * 20 + ["Chanel bag"] * 60)
    assert routing.infer_brand(df).first()["target_brand"] == "chanel"
    assert routing.infer_brand(df, sample=20).first()["target_brand"] == "gucci"


def test_aliases_of_any_length(spark):
    aliases = spark.createDataFrame(
        [("the house of four words", 23, "four"), ("house", 5, "one")], "alias string, alias_len int, brand string"
    )
    df = spark.createDataFrame([(1, "By the House of Four Words, new"), (2, "A house"), (3, "none")], "id int, title string")
    got = {r["id"]: r["brand"] for r in routing.detect_brand(df, "title", aliases, ["id"]).collect()}
    assert got == {1: "four", 2: "one", 3: None}
    assert routing.detect_brand(df, "title", aliases.limit(0), ["id"]).where("brand IS NULL").count() == 3


def test_deep_json_stops_nothing(spark):
    deep, good = "[" * 200_000, '{"name": "bag", "price": 5}'
    nested = '{"a":' * 900 + "1" + "}" * 900
    df = spark.createDataFrame([(1, [deep, good]), (2, [good]), (3, None), (4, [nested, good])], "id int, texts array<string>")
    got = {r["id"]: r["p"] for r in df.select("id", o.price_from_objects(o.json_objects("texts"))["price"].alias("p")).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: None, 4: 5.0}


def test_price_beside_deep_json_is_found(spark):
    """JSON nested deeper than Python follows is read with a list of open values."""
    side = '{"price": "700", "a": ' + "[" * 200_000 + "]" * 200_000 + "}"
    nested = '{"a":' * 50_000 + '{"name": "b\\u00e9", "price": 1.5e1}' + "}" * 50_000
    broken = ['{"price": "700", "a": ' + "[" * 200_000, '{"a" 1}', "no json"]
    df = spark.createDataFrame([(1, [side]), (2, [nested]), (3, broken), (4, None)], "id int, texts array<string>")
    got = df.select("id", o.price_from_objects(o.json_objects("texts"))["price"].alias("p"), o.json_problems("texts").alias("why")).collect()
    assert {r.id: (r.p, len(r.why)) for r in got} == {1: (700.0, 0), 2: (15.0, 0), 3: (None, 3), 4: (None, 0)}


def test_parser_of_any_depth_reads_what_the_usual_one_reads():
    import json
    import random

    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind < 6:
            return rng.choice([None, True, False, -3, 1.5, 1e20, "x", 'q"\\ é', "", 0])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 6 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}

    for _ in range(300):
        v = [value(5)]
        for text in (json.dumps(v), json.dumps(v, indent=1, ensure_ascii=False)):
            assert o.parse_deep(text) == v
    for bad in ("[1,]", "[,1]", '{"a":}', '{"a":1,}', "{1:2}", "[1 2]", "[1}", '{"a"}', '["x]', "[tru]", "["):
        with pytest.raises(ValueError):
            o.parse_deep(bad)


def test_keys_of_a_script_in_their_order(spark):
    scripts = [
        '{"amount": 5, "currency":"USD", "price": 700}', "var value = 3; var priceValue = 9;", '{"price": 12000, "amount": 40, "currency": "EUR"}', "nothing",
    ]
    df = spark.createDataFrame([(k, [s]) for k, s in enumerate(scripts)], "id int, scripts array<string>")
    got = {r["id"]: r["p"] and (r["p"]["price"], r["p"]["currency"]) for r in df.select("id", extract.price_from_scripts(F.col("scripts")).alias("p")).collect()}
    assert got == {0: (700.0, "USD"), 1: (9.0, None), 2: (40.0, "EUR"), 3: None}
    wide = df.select("id", extract.price_from_scripts(F.col("scripts"), limit=20_000.0)["price"].alias("p"))
    assert {r["id"]: r["p"] for r in wide.collect()}[2] == 12000.0


def test_the_limit_follows_the_currency(spark):
    df = spark.createDataFrame([(1, ['{"price": 120000, "currency": "JPY"}']), (2, ['{"price": 120000, "currency": "USD"}']), (3, ['{"price": 9500, "currency": "EUR"}'])], "id int, scripts array<string>")
    got = {r["id"]: r["p"] for r in df.select("id", extract.price_from_scripts(F.col("scripts"))["price"].alias("p")).collect()}
    assert got == {1: 120000.0, 2: None, 3: 9500.0}


def test_without_a_product_id_any_object_counts(spark):
    df = spark.createDataFrame([(['{"sku": "77", "price": 150, "priceCurrency": "EUR"}'],)], "texts array<string>")
    objects = o.json_objects("texts")
    price = lambda pid: df.select(o.matched_price(objects, pid)["price"]).first()[0]
    assert price(F.lit(None).cast("string")) == 150.0 and price(F.lit("77")) == 150.0 and price(F.lit("78")) is None


EVENTS = "event_id bigint, ts timestamp, proxy string, proxy_type string, domain string, ok boolean, error string"


def events(spark, rows):
    """(minute, type, ok, error) of one proxy, as events."""
    data = [(k, (m + 1000) * 60, "p", kind, "d", ok, error) for k, (m, kind, ok, error) in enumerate(rows)]
    return spark.createDataFrame(data, EVENTS.replace("timestamp", "bigint")).withColumn("ts", F.timestamp_seconds("ts"))


def test_a_critical_error_marks_a_rotating_proxy(spark):
    rows = [(0, "rotating", False, "407 proxy authentication required"), (200, "rotating", None, None), (201, "rotating", False, "HTTP 429"), (400, "rotating", True, None), (401, "rotating", False, "timeout")]
    got = [(r["streak"], r["is_bad"]) for r in crawl.failure_streaks(events(spark, rows)).orderBy("event_id").collect()]
    assert [bad for _, bad in got] == [True, True, True, False, False] and got[-1][0] == 1
    static = crawl.failure_streaks(events(spark, [(0, "static", False, "407 proxy authentication required")])).first()
    assert not static["is_bad"]


def test_open_fetches_are_no_failures(spark):
    rows = [(0, "rotating", False, "timeout"), (1, "rotating", None, None), (2, "rotating", False, "timeout")]
    got = quarantine_states(events(spark, rows)).orderBy("event_id").collect()
    assert [(r["event_id"], r["streak"]) for r in got] == [(0, 1), (2, 2)]


def test_no_snapshot_from_the_future(spark):
    rows = spark.createDataFrame([("h", 1000, "old"), ("h", 5000, "future"), ("g", 5000, "future")], "image_hash string, s bigint, payload string")
    df = rows.select("image_hash", F.timestamp_seconds("s").alias("written_at"), "payload")
    got = snapshots.fresh_snapshots(df, F.timestamp_seconds(F.lit(2000))).collect()
    assert [(r["image_hash"], r["payload"], r["cache_age"]) for r in got] == [("h", "old", 1000)]


def test_a_group_of_equal_leads_is_cut_evenly(spark):
    """One analysis holds all rows and its leading column is the same everywhere."""
    from tagworth.operators import groups as g

    df = spark.range(4000).select(F.lit("a").alias("analysis_id"), F.lit(1).alias("section_rank"), ((F.col("id") * 7919) % 4000).alias("pos"))
    out = g.rank_in_group(df, ["analysis_id"], [F.col("section_rank"), F.col("pos")], parts=8).cache()
    assert out.where("rank <> pos + 1").count() == 0
    shares = df.repartitionByRange(8, "analysis_id", "section_rank", "pos").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert shares < 1000


def dealt_stream(spark, rows, folder):
    """Events as a stream of several files, read one by one in the order of their names."""
    for k, part in enumerate(rows):
        frame = events(spark, part).withColumn("event_id", F.col("event_id") + 100 * k)
        frame.coalesce(1).write.parquet(f"{folder}/{k}")
    schema = events(spark, rows[0]).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/*")


def test_late_rows_give_the_batch_result(spark, tmp_path):
    """Rows out of order over several files, the last of which closes the stream."""
    from tagworth.plans.q_streams import _exact
    from tagworth.streaming import crawl as c
    from tagworth.streaming.run import run_available

    parts = [
        [(0, "rotating", False, "HTTP 403 access denied"), (9, "rotating", False, "Read timed out")],
        [(4, "rotating", True, None), (3, "rotating", False, "Proxy blocked by target"), (12, "rotating", False, "HTTP 403 access denied")],
        [(8, "rotating", False, "HTTP 403 access denied"), (10, "rotating", None, None), (15, "rotating", False, "Read timed out")],
        [(100_000, "rotating", False, "HTTP 403 access denied")],
    ]
    whole = None
    for k, part in enumerate(parts[:3]):
        frame = events(spark, part).withColumn("event_id", F.col("event_id") + 100 * k)
        whole = frame if whole is None else whole.unionAll(frame)
    _exact(spark)
    stream = dealt_stream(spark, parts, str(tmp_path / "in"))
    held = run_available(c.soft_block_holds(stream, late="20 minutes"), str(tmp_path / "holds"))
    want = crawl.soft_block_flags(whole).select("event_id", "hits", F.unix_micros("hold_until"))
    assert sorted(map(tuple, held.select("event_id", "hits", "hold_until").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    states = run_available(c.quarantine_stream(stream, late="20 minutes"), str(tmp_path / "states"))
    want = quarantine_states(whole).select("event_id", "streak", "hold_until")
    assert sorted(map(tuple, states.select("event_id", "streak", "hold_until").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_repeats_after_the_cache_time_are_new(spark, tmp_path):
    from tagworth.streaming.logs import dedupe_stream
    from tagworth.streaming.run import run_available

    rows = [[("h", 0), ("h", 50)], [("h", 90), ("g", 5000)], [("q", 6000)], [("h", 9000)], [("z", 90_000)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "image_hash string, s bigint").select("image_hash", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("image_hash string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = run_available(dedupe_stream(stream, ttl_sec=100), str(tmp_path / "out")).collect()
    assert sorted((r["image_hash"], int(r["ts"].timestamp())) for r in got)[0][0] == "g" and sum(r["image_hash"] == "h" for r in got) == 2
