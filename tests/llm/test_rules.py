"""Quality rules, license scans and mixing with odd rows, and all queries against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagworth.llm import license_scan, mixing, quality_rules
from tagworth.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, topic string, tokens string, k int, w int, values int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "t", "x", 1, 2, 3) for i, t, lang, s in rows], SCHEMA)


def counts_by_hand(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def rule_rows():
    rng = random.Random(4)

    def prose(n):
        return " ".join(rng.choice(["river", "stone", "walks", "under", "a", "great", "many", "houses"]) + str(rng.randrange(500)) for _ in range(n))

    rows = [(k, prose(60), "en", "web") for k in range(80)]
    rows += [(100 + k, prose(40) + " ## $$ %% " * 20, "en", "web") for k in range(4)]
    again = prose(9)
    rows += [
        (200, None, "en", "web"), (201, "", None, None), (202, " \n\t", "en", None), (203, "a b c " * 40, "en", "web"), (204, (prose(30) + "\n") * 2, "fr", "x"),
        (205, again + " and " + again + prose(30), "en", "web"), (206, prose(30) + "\nsame line here\n same line here\nsame line here", None, "web"),
        (None, prose(25), None, None), (207, prose(4000), "en", "web"), (208, prose(25), "xx", "new"), (208, prose(25), "xx", "new"), (209, "#" * 5000, "en", "web"),
        (210, "x" * 70 + " é ßß Ä " * 30, "de", "web"),
    ]
    return rows


def test_rule_counts(spark):
    rows = rule_rows()
    out = quality_rules.quality_rules(frame(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=str)
    assert got == sorted(((i, *counts_by_hand(t)) for i, t, _, _ in rows), key=str)
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[k].kept for k in range(80)) and not any(by_id[100 + k].kept for k in range(4))
    assert by_id[203].base_failed and by_id[200].base_failed and by_id[201].base_failed
    assert by_id[208].limit_level == 0 and by_id[0].limit_level == 2 and by_id[205].limit_level == 2


def test_limits_follow_the_habits_of_a_source(spark):
    """Two sources, one of which shouts, repeats itself and uses symbols and long words: each has its own limits."""
    rng = random.Random(6)

    def text(loud):
        words = [rng.choice(["stone", "river", "house", "walks"]) + ("x" * rng.randrange(6) if loud else "") + str(rng.randrange(900)) for _ in range(60)]
        if loud:
            words += ["AB"] * rng.randrange(1, 5) + ["##"] * rng.randrange(1, 9) + words[: rng.choice([0, 9, 12])]
        lines = [" ".join(words[i : i + 10]) for i in range(0, len(words), 10)]
        return "\n".join(lines + lines[: rng.randrange(3) if loud else 0])

    rows = [(k, text(k % 2 == 1), "en", "loud" if k % 2 else "calm") for k in range(1600)]
    measures = quality_rules.quality_rules(frame(spark, rows))
    his = lambda rows: {r.g_source: [b.hi for b in r.bounds] for r in quality_rules.limits(quality_rules.sketches(rows)).collect()}
    both, calm = his(measures), his(measures.where("source = 'calm'"))["calm"]
    loud = his(measures.where("source = 'loud'"))["loud"]
    assert (both["loud"][0], both["loud"][4]) == (loud[0], loud[4])  # tails of few texts are those of the language
    assert all(a < b for a, b in zip(calm, both["loud"]))
    assert calm[:4] == [r.floor for r in quality_rules.RULES[:4]]  # without a habit of its own it takes the language's
    assert all(a > b for a, b in zip(both["calm"][:4], calm[:4]))


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_most_limits_are_set_by_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sketch = quality_rules.sketches(quality_rules.quality_rules(docs))
    every = [b.hi for r in quality_rules.limits(sketch).collect() for b in r.bounds]
    floors = [r.floor for r in quality_rules.RULES]
    assert sum(hi not in floors for hi in every) > len(every) / 2


def test_rules_of_nothing(spark):
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0
    assert not quality_rules.quality_rules(frame(spark, [(1, None, None, None)])).first().kept


NOTICE = dict(license_scan.NOTICES)


def license_rows():
    filler = " ".join(f"word{k}" for k in range(700))
    full = NOTICE["MIT-full"].split()
    edited = " ".join(w if k % 25 else "other" for k, w in enumerate(full))
    return [
        (1, filler + "\n" + NOTICE["MIT"] + "\n" + filler, "en", "s"), (2, NOTICE["MIT-full"].upper(), "en", "s"), (3, filler + " " + edited + " " + filler, "en", "s"),
        (4, NOTICE["Apache-2.0"], None, None), (5, " ".join(full[: len(full) // 3]), "en", "s"), (6, None, "en", "s"), (7, "", "en", "s"), (8, "the MIT license", "en", "s"),
        (9, filler * 20 + "\nlicensed,under--the apache LICENSE version 2 0", "en", "s"), (None, NOTICE["GPL-3.0"], "en", "s"), (9, "é " + NOTICE["CC-BY-NC-4.0"], "en", "s"),
        (11, (NOTICE["MIT"] + "\n") * 30, "en", "s"),
    ]


def licenses_by_hand(rows):
    def shingles(t):
        w = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out = set()
    for name, text in license_scan.NOTICES:
        want = set(shingles(text))
        step = 1
        while step < len(want):
            step *= 2
        for i, t, _, _ in rows:
            s = shingles(t)
            best = max((len(want & set(s[a : a + 2 * step])) for a in range(0, max(len(s), 1), step)), default=0)
            if best >= 0.75 * len(want):
                out.add((i, name, len(want), best))
    return out


def test_licenses(spark):
    rows = license_rows()
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert {(r.doc_id, r.license, r.n_template, r.n_found) for r in got} == licenses_by_hand(rows)
    assert {(1, "MIT"), (2, "MIT-full"), (3, "MIT-full"), (9, "Apache-2.0"), (9, "CC-BY-NC-4.0"), (None, "GPL-3.0")} <= {(r.doc_id, r.license) for r in got}
    assert license_scan.license_scan(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_scan.template_table(spark, [("short", "too few words")])


def test_band_settings():
    for n in range(1, 300):
        k = 0 if n == 1 else (n - 1).bit_length()
        assert license_scan.miss_probability(n, 2 * 2**k, 0.75, 3) < 1e-5


def mix_rows():
    rng = random.Random(9)
    rows = [(k, "word " * rng.randrange(5, 50), rng.choice(["en", "en", "en", "fr", None]), rng.choice(["big", "big", "big", "small", None])) for k in range(600)]
    rows += [(1000 + k, "a | b | c " * 5, "en", "big") for k in range(30)] + [(2000, None, "en", "big"), (2001, "", "zz", "alone"), (None, "x y", "en", "small"), (5, rows[5][1], "en", "big")]
    return rows


def test_marginals(spark):
    out = mixing.mix(frame(spark, mix_rows()), keep=0.4, sweeps=30).cache()
    total = out.agg(F.sum("tokens")).first()[0]
    weight = F.sum(F.col("rate") * F.col("tokens")) / total
    langs = {r.lang: r.w for r in out.groupBy("lang").agg(weight.alias("w")).collect()}
    assert langs["en"] == pytest.approx(0.45 / 0.75, abs=1e-6) and langs["fr"] == pytest.approx(0.2 / 0.75, abs=1e-6) and langs[None] == pytest.approx(0.1 / 0.75, abs=1e-6)
    sources = {r.source: (r.w, r.t) for r in out.groupBy("source").agg(weight.alias("w"), F.sum("tokens").alias("t")).where("t > 0").collect()}
    mass = sum(t**0.5 for _, t in sources.values())
    assert all(w == pytest.approx(t**0.5 / mass, rel=0.02) for w, t in sources.values())
    assert out.agg(F.sum(F.col("probability") * F.col("tokens"))).first()[0] == pytest.approx(0.4 * total, rel=1e-6)
    assert out.where("selected").agg(F.sum("tokens")).first()[0] == pytest.approx(0.4 * total, rel=0.15)
    assert out.count() == len(mix_rows()) and out.where("doc_id = 2001").first().probability == 0
    assert out.columns.count("tokens") == 1


def test_join_without_broadcast_is_the_same(spark):
    rows = mix_rows()
    a, b = (mixing.mix(frame(spark, rows), sweeps=3, broadcast_cells=n).select("doc_id", "probability") for n in (0, 100_000))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_many_cells_are_raked_by_joins(spark):
    rows = mix_rows()
    a, b = ({r.doc_id: r.probability for r in mixing.mix(frame(spark, rows), sweeps=3, small_cells=n).collect()} for n in (0, 100_000))
    assert a == pytest.approx(b, rel=1e-9)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tagworth.plans.check import compare

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) == ""
