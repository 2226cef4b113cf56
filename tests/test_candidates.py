"""Ranking and merging: ties, order independence, hot groups, brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tagworth.operators import candidates as c
from tagworth.operators import groups as g
from tagworth.operators.crawl import failure_streaks

SCHEMA = (
    "analysis_id string, section_rank int, pos bigint, serp_source string, url string, title string, image string, "
    "serp_price double, serp_currency string, similarity double, selection_priority int, title_rank int"
)
SOURCES = ["exact_matches", "visual_matches", "organic_results", "shopping_results"]


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # one analysis holds most rows
        a = "hot" if rng.random() < 0.8 else rng.choice("xyz")
        s = rng.randrange(4)
        domain = rng.choice(["ebay.com", "ebay.de", "rebag.com", "therealreal.com", "poshmark.com"])
        url = "" if rng.random() < 0.05 else f"https://{domain}/a/{rng.randrange(40)}"
        price = rng.choice([None, 10.0 * i])
        out.append(
            (a, s, i, SOURCES[s], url, rng.choice(["", f"t{i}"]), rng.choice(["", f"i{i}"]), price,
             "USD" if price else None, round(rng.random(), 2), rng.randrange(2), rng.randrange(5))
        )
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


def frame(spark, data, parts=5):
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def by_analysis(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2], r[4])):
        out.setdefault(r[0], []).append(r)
    return out


def test_merge_by_link_matches_a_plain_loop(spark, data):
    want = {}
    for a, rs in by_analysis(data).items():
        merged = {}
        for r in rs:
            if not r[4]:
                continue
            e = merged.setdefault(r[4], {"price": None, "title": "", "image": "", "sources": []})
            if e["price"] is None and r[7] is not None:
                e["price"] = r[7]
            e["title"] = e["title"] or r[5]
            e["image"] = e["image"] or r[6]
            if r[3] not in e["sources"]:
                e["sources"].append(r[3])
        want.update({(a, u): (e["price"], e["title"], e["image"], e["sources"]) for u, e in merged.items()})
    got = {
        (r["analysis_id"], r["url"]): (r["serp_price"], r["title"], r["image"], r["serp_sources"])
        for r in c.merge_by_link(frame(spark, data)).collect()
    }
    assert got == want


def loop_buckets(rs, cap1, limit, cap2):
    seen, counts, first, second = set(), {}, [], []
    for r in rs:
        if len(first) >= limit:
            break
        d = r[4].split("/")[2] if r[4] else ""
        if not r[4] or r[4] in seen or counts.get(d, 0) >= cap1:
            continue
        first.append(r[4]); seen.add(r[4]); counts[d] = counts.get(d, 0) + 1
    counts = {}
    for r in rs:
        d = r[4].split("/")[2] if r[4] else ""
        if not r[4] or r[4] in seen or counts.get(d, 0) >= cap2:
            continue
        second.append(r[4]); seen.add(r[4]); counts[d] = counts.get(d, 0) + 1
    return first, second


def test_two_buckets_match_a_plain_loop(spark, data):
    got = {}
    for r in c.two_buckets(frame(spark, data), 2, 6, 4).collect():
        got.setdefault(r["analysis_id"], {1: set(), 2: set()})[r["bucket"]].add(r["url"])
    for a, rs in by_analysis(data).items():
        first, second = loop_buckets(rs, 2, 6, 4)
        assert got[a] == {1: set(first), 2: set(second)}


def loop_batch(rs, limit):
    speed = lambda d: 0 if d.startswith("ebay.") or d in ("rebag.com", "poshmark.com") else 2
    seen, unique = set(), []
    for r in rs:
        if r[4] and r[4] not in seen:
            seen.add(r[4]); unique.append(r)
    dom = lambda r: r[4].split("/")[2]
    ordered = sorted(unique, key=lambda r: (speed(dom(r)), r[3] != "exact_matches", r[10], r[11], -r[9], r[1], r[2], r[4]))
    picked, counts, ebay = [], {}, 0
    for r in ordered:
        d = dom(r)
        if d.startswith("ebay.") and ebay >= 1:
            continue
        if counts.get(d, 0) >= (2 if d == "therealreal.com" else 3):
            continue
        picked.append(r[4]); counts[d] = counts.get(d, 0) + 1; ebay += d.startswith("ebay.")
        if len(picked) >= limit:
            break
    picked += [r[4] for r in ordered if r[4] not in picked][: max(0, limit - len(picked))]
    return picked


@pytest.mark.parametrize("limit", [5, 12])
def test_next_crawl_batch_matches_a_plain_loop(spark, data, limit):
    got = {}
    for r in c.next_crawl_batch(frame(spark, data), limit).orderBy("pick").collect():
        got.setdefault(r["analysis_id"], []).append(r["url"])
    for a, rs in by_analysis(data).items():
        assert got[a] == loop_batch(rs, limit)


def test_rank_in_group_is_exact_on_a_hot_group(spark, data):
    df = frame(spark, data)
    out = g.rank_in_group(df, ["analysis_id"], [F.col("similarity"), F.col("pos")], F.col("similarity"), parts=8)
    for a, rs in by_analysis(data).items():
        order = [r[2] for r in sorted(rs, key=lambda r: (r[9], r[2]))]
        got = [r["pos"] for r in out.filter(F.col("analysis_id") == a).orderBy("rank").collect()]
        assert got == order


def test_top_and_rest_cover_everything(spark, data):
    df = frame(spark, data)
    order = [F.col("section_rank"), F.col("pos")]
    top = g.top_k(df, ["analysis_id"], order, 7)
    rest = g.beyond_top(df, top, ["analysis_id"], order, 7)
    assert top.count() + rest.count() == len(data)
    assert top.join(rest, ["analysis_id", "pos"]).count() == 0


def test_long_lists_are_cut_into_parts(spark, data):
    out = g.chunk_lists(frame(spark, data), ["analysis_id"], [F.col("pos")], F.col("pos"), F.col("pos"), "items", 50)
    hot = [r for r in out.orderBy("part").collect() if r["analysis_id"] == "hot"]
    flat = [p for r in hot for p in r["items"]]
    assert flat == sorted(r[2] for r in data if r[0] == "hot") and max(len(r["items"]) for r in hot) <= 50


def test_results_do_not_depend_on_partitioning(spark, data):
    mixed = list(data)
    random.Random(9).shuffle(mixed)
    for op in (c.merge_by_link, lambda d: c.cap_per_domain(d, 2, 9), c.dedupe_canonical, lambda d: c.candidate_rank(d, 10)):
        a = sorted(map(str, op(frame(spark, data, 3)).collect()))
        assert sorted(map(str, op(frame(spark, mixed, 8)).collect())) == a


def test_streaks_across_slots(spark):
    rng = random.Random(5)
    events, want, streak = [], {}, 0
    for i in range(300):
        ok = rng.random() < 0.25
        error = None if ok else rng.choice(["proxy blocked", "read timed out", "403"])
        streak = 0 if ok else streak + (error != "proxy blocked")
        want[i] = streak
        events.append((i, 1_700_000_000 + i * 97, "p", "rotating", "d", ok, error))
    df = spark.createDataFrame(events, "event_id bigint, t bigint, proxy string, proxy_type string, domain string, ok boolean, error string")
    df = df.withColumn("ts", F.timestamp_seconds("t")).repartition(6)
    got = {r["event_id"]: r["streak"] for r in failure_streaks(df, slot_sec=600).collect()}
    assert got == want


def _watched(monkeypatch):
    """The columns of each staged table, as they are written."""
    seen, whole = [], g.staged
    monkeypatch.setattr(g, "staged", lambda df: seen.append(df.columns) or whole(df))
    return seen


def test_ranked_rows_move_once(spark, monkeypatch):
    """A hot group in many ranges: rows are staged without copies of their order and not dealt again."""
    seen = _watched(monkeypatch)
    df = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("a"), F.col("id") % 3)).when(F.col("id") != 7, F.lit("hot")).alias("k"), ((F.col("id") * 7919) % 4001).alias("x"), F.lit("wide").alias("t"), F.lit("unused").alias("u")
    )
    out = g.rank_in_group(df, ["k"], [F.col("x"), F.col("t")], F.col("x"), parts=16, keep=["x", "t"])
    rows = out.collect()
    for k in {r.k for r in rows}:
        assert [r["rank"] for r in sorted((r for r in rows if r.k == k), key=lambda r: r.x)] == list(range(1, sum(r.k == k for r in rows) + 1))
    assert len(rows) == 3999 and None not in {r.k for r in rows} and sum(r.k == "hot" for r in rows) == 3599
    assert seen[0] == ["k", "x", "t", "_at"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_cards_stage_only_what_they_show(spark, monkeypatch):
    from tagworth.operators import report

    seen = _watched(monkeypatch)
    df = spark.sql(
        "SELECT 'a' AS analysis_id, id AS pos, 't' AS title, 's' AS site, 'Sold' AS status, 1.0D AS price, 'used' AS condition, 0.5D AS similarity, "
        "2.0D AS price_original, 'EUR' AS currency_original, 'https://e.com/1' AS url, 'x' AS image FROM range(50)"
    )
    out = report.report_cards(df, [F.col("pos")])
    assert sorted(r.card_no for r in out.collect()) == list(range(1, 51))
    assert not {"image", "pos", "_o0"} & set(seen[0])
