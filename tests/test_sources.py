"""Sinks and sources round trips."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from tagworth.sources import logs, results, search, snapshots


def test_search_payload_variants(spark):
    payload = {
        "exact_matches": [{"link": "https://www.ebay.com/itm/1", "title": "A $50", "thumbnail": "t"}, {"source": "https://x.com/1"}],
        "visual_matches": [{"link": "https://www.ebay.com/itm/1", "price": "$70"}, {"link": "", "title": "no link"}],
        "organic_results": [{"link": "https://nowhere.org/1"}, {"link": "https://rebag.com/2", "extracted_price": 90}],
        "shopping_results": None,
    }
    df = spark.createDataFrame([("a", json.dumps(payload)), ("b", "not json")], "analysis_id string, payload string")
    got = {r["url"]: r for r in search.read_search_results(df).collect()}
    assert set(got) == {"https://www.ebay.com/itm/1", "https://x.com/1", "https://rebag.com/2"}
    assert (got["https://www.ebay.com/itm/1"]["serp_price"], got["https://www.ebay.com/itm/1"]["serp_sources"]) == (
        50.0, ["exact_matches", "visual_matches"]
    )
    assert (got["https://rebag.com/2"]["serp_price"], got["https://rebag.com/2"]["serp_currency"]) == (90.0, "USD")


def test_snapshot_round_trip(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [("h", at, "old"), ("h", at + dt.timedelta(hours=1), "new"), ("k", at - dt.timedelta(days=3), "stale")]
    df = spark.createDataFrame(rows, "image_hash string, written_at timestamp, payload string").withColumn("cached", F.lit(True))
    snapshots.write_snapshots(df, str(tmp_path / "s"))
    back = snapshots.read_snapshots(spark, str(tmp_path / "s"))
    fresh = snapshots.fresh_snapshots(back, F.lit("2024-01-01 14:00:00").cast("timestamp")).collect()
    assert [(r["image_hash"], r["payload"], r["cache_age"]) for r in fresh] == [("h", "new", 3600)]
    assert "cached" not in back.columns


def test_result_sink(spark, tmp_path):
    head = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "analysis_id string, median_price_usd double")
    items = spark.createDataFrame([("a", 1, "u1"), ("a", 2, "u2")], "analysis_id string, pos int, url string")
    rejected = spark.createDataFrame([("a", "u9", "catalog_page")], "analysis_id string, url string, reason_code string")
    results.write_results(results.nested_results(head, items, rejected), str(tmp_path / "r"))
    got = {r["analysis_id"]: r for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert [i["url"] for i in got["a"]["items"]] == ["u1", "u2"] and got["a"]["filtered_items"][0]["url"] == "u9"
    assert got["b"]["items"] is None and (got["a"]["n_items"], got["b"]["n_items"], got["a"]["n_filtered_items"]) == (2, 0, 1)


def test_one_headline_row_whatever_the_size(spark):
    head = spark.createDataFrame([("a", 10.0)], "analysis_id string, median_price_usd double")
    items = spark.range(2500).selectExpr("'a' AS analysis_id", "id AS pos", "concat('u', id) AS url")
    row = results.nested_results(head, items).collect()
    assert len(row) == 1 and row[0].n_items == 2500 and [i.pos for i in row[0]["items"]] == list(range(100))
    lists = {r.part: [i.pos for i in r["items"]] for r in results.item_lists(items).collect()}
    assert [p for k in sorted(lists) for p in lists[k]] == list(range(2500)) and len(lists) == 3


def test_batches_are_stored_once(spark, tmp_path):
    store = results.ResultStore(spark, str(tmp_path / "r"))
    assert store.batches().count() == 0
    tables = lambda n, k: {"headline": spark.range(n).selectExpr("id", f"{k} AS k"), "items": spark.range(3 * n).repartition(3)}
    assert store.write(0, tables(5, 0)) and store.write(1, tables(7, 1)) and not store.write(1, tables(9, 9))
    tables(4, 2)["headline"].write.parquet(str(tmp_path / "r/headline/batch=2"))  # an attempt that stopped half-way
    assert store.read("headline").count() == 12 and store.read("items").count() == 36
    assert store.write(2, tables(2, 2)) and store.read("headline").where("k = 2").count() == 2
    before = sorted(map(tuple, store.read("items").collect()))
    assert store.compact("items") == 3 and store.compact("items") == 0
    assert sorted(map(tuple, store.read("items").collect())) == before and len(spark.read.parquet(f"{store.path}/items").inputFiles()) == 3


def test_stream_into_the_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = results.ResultStore(spark, str(tmp_path / "r"))

    def run(checkpoint):
        rows = spark.readStream.schema("id bigint").json(str(tmp_path / "in"))
        query = rows.writeStream.foreachBatch(store.each_batch(lambda df: {"items": df})).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()

    (tmp_path / "in/a.json").write_text('{"id": 1}\n{"id": 2}\n')
    run("c1")
    run("c2")  # the checkpoint is lost: batch 0 runs again
    assert sorted(r.id for r in store.read("items").collect()) == [1, 2]
    (tmp_path / "in/b.json").write_text('{"id": 3}\n')
    run("c1")
    assert sorted(r.id for r in store.read("items").collect()) == [1, 2, 3]


def test_event_log(spark, tmp_path):
    line = {"ts": "2024-01-01T00:00:00.000", "level": "INFO", "event": "scrape.start", "domain": "a.com", "seconds": 1.5}
    (tmp_path / "log.json").write_text(json.dumps(line) + "\n")
    r = logs.read_event_log(spark, str(tmp_path)).first()
    assert (r["event"], r["seconds"]) == ("scrape.start", 1.5)


def test_unparsed_pages_of_a_shared_url(spark):
    from tagworth.operators.listings import unparsed_pages

    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, None, "c")], "page_id int, url string, html string")
    parsed = spark.createDataFrame([(1, "u", "t", None), (2, "u", None, None), (3, None, " ", None)], "page_id int, url string, title string, price double")
    assert sorted(r["html"] for r in unparsed_pages(parsed, pages).collect()) == ["b", "c"]


def test_nested_results_query_holds_every_item(spark):
    from tagworth.plans import ORACLES, QUERIES

    rows = QUERIES["nested_results"](spark, "/root/testdata/sf0.001").groupBy("analysis_id").agg({"n": "sum", "n_items": "max"}).collect()
    assert rows and all(r["sum(n)"] == r["max(n_items)"] > 100 for r in rows)
    assert "least(" not in ORACLES["nested_results"]


def test_listing_pages_are_dealt_to_all_cores(spark):
    from tagworth.plans.fixtures import fixture

    pages = fixture(spark, "/root/testdata/sf0.01", "listing_pages")
    filled = pages.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count()
    assert filled >= spark.sparkContext.defaultParallelism


def test_only_legacy_rows_that_depend_on_others_move(spark):
    """Priced rows of other sections stay where they are; links repeat over payloads, nulls as before."""
    row = lambda a, rank, pos, url, price: (a, rank, pos, search.SECTIONS[rank], url, "", "bag", price, "EUR" if price else None)
    rows = [
        row("a", 1, 0, "u", None), row("a", 1, 1, "u", 5.0), row("a", 2, 3, "u", 7.0), row("a", 2, 2, "u", 8.0), row("a", 3, 0, "u", None),
        row("a", 2, 0, "v", None), row("a", 2, 1, "v", 9.0), row("b", 1, 0, "u", None), row(None, 1, 0, "u", 1.0), row(None, 3, 0, "u", 2.0), row("b", 3, 1, "", 3.0),
    ]
    df = spark.createDataFrame(rows, "analysis_id string, section_rank int, pos int, serp_source string, url string, image string, title string, serp_price double, serp_currency string")
    out = search._legacy(df)
    got = sorted(((r.analysis_id or "", r.section_rank, r.pos, r.url, r.serp_price, r.serp_currency) for r in out.collect()), key=str)
    assert got == sorted([
        ("a", 1, 0, "u", 8.0, "EUR"), ("a", 1, 1, "u", 5.0, "EUR"), ("a", 3, 0, "u", None, "USD"), ("a", 2, 0, "v", 9.0, "EUR"),
        ("b", 1, 0, "u", None, "USD"), ("", 3, 0, "u", 2.0, "EUR"),
    ], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(analysis_id" not in plan and "Expand" not in plan  # keys are hashes, no link texts
