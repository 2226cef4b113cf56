"""Bitmaps of seen keys, and the automaton of aliases against the join form."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tagworth.functions.automaton import Automaton
from tagworth.operators import candidates, membership, routing


def keys(spark, rows):
    return spark.createDataFrame(rows, "analysis_id string, url string, _maybe int")


def test_only_unseen_rows_stay(spark):
    rows = [(f"a{k % 7}", f"u{k}", k) for k in range(3000)] + [("a0", None, 1), (None, "u1", 2), ("a1", "u1", 3), ("a1", "u1", 3)]
    seen = [(f"a{k % 7}", f"u{k}", 0) for k in range(0, 3000, 3)] + [("a0", None, 1), ("a9", "u9", 0)]
    want = sorted((r for r in rows if r[:2] not in {s[:2] for s in seen} or None in r[:2]), key=str)
    for bits in (15, 20):  # the smaller is nearly full
        got = candidates.exclude_seen(keys(spark, rows).drop("_maybe").withColumn("n", F.lit(1)), keys(spark, seen), bits=bits).select("analysis_id", "url")
        assert sorted((tuple(r) for r in got.collect()), key=str) == [w[:2] for w in want]
    empty = keys(spark, [])
    assert candidates.exclude_seen(keys(spark, rows), empty).count() == len(rows) and candidates.exclude_seen(empty, keys(spark, seen)).count() == 0


def test_days_merge_and_most_rows_are_decided_in_place(spark):
    on = ["analysis_id", "url"]
    days = [keys(spark, [("a", f"u{d}-{k}", 0) for k in range(2000)]) for d in range(3)]
    merged = membership.merged_bitmaps(*[membership.key_bitmaps(x, on, 20) for x in days])
    whole = membership.key_bitmaps(days[0].union(days[1]).union(days[2]), on, 20)
    assert sorted((r.bucket, bytes(r.bits)) for r in merged.collect()) == sorted((r.bucket, bytes(r.bits)) for r in whole.collect())
    assert 11_800 < membership.filled(merged).first()[0] <= 12_000
    told = membership.marked(keys(spark, [("a", f"new{k}", 0) for k in range(5000)]), on, merged, bits=20)
    assert told.where("maybe_seen").count() < 15
    assert membership.marked(days[1], on, merged, bits=20).where("NOT maybe_seen").count() == 0


def test_automaton_is_the_join(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    names = {" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 2, 3, 5]))) for _ in range(3000)}
    aliases = spark.createDataFrame([(n, len(n), f"b{k}") for k, n in enumerate(sorted(names))], "alias string, alias_len int, brand string")
    texts = [(k, " ".join(rng.choice([*words, "unknown"]) for _ in range(rng.choice([0, 1, 3, 12, 700])))) for k in range(400)] + [(400, None)]
    df = spark.createDataFrame(texts, "id int, title string")
    a, b = (routing.detect_brand(df, "title", aliases, ["id"], most_aliases=n).select("id", "brand").collect() for n in (200_000, 0))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and sum(r.brand is not None for r in a) > 300


def test_a_hundred_thousand_aliases(spark):
    many = spark.range(100_000).selectExpr("concat('brand ', id, ' bags') AS alias", "id AS n").selectExpr("alias", "length(alias) AS alias_len", "concat('b', n) AS brand")
    df = spark.range(2000).selectExpr("id", "concat('a used Brand ', id * 53, ' bags item, brand ', id) AS title")
    a, b = (routing.detect_brand(df, "title", many, ["id"], most_aliases=n).select("id", "brand") for n in (200_000, 10))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.where("brand IS NULL").count() == 2000 - 1887


def test_suffixes_that_are_phrases():
    import numpy as np
    import pyarrow as pa

    a = Automaton(["c", "b c", "a b x", "b"], [0, 3, 2, 1])
    find = lambda *texts: list(a.find(pa.array([w for t in texts for w in t.split()], pa.string()), np.array([len(t.split()) for t in texts])))
    assert find("a b c", "a b x", "c", "x", "", "a b a b") == [3, 2, 0, -1, -1, 1]
    assert Automaton([], []).find(pa.array(["x"]), np.array([1])).tolist() == [-1]
