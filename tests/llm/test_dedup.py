"""Line, exact and near duplicates against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagworth.llm import exact_dedup, graph, line_dedup, near_dedup, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, name string, id string, pos int"


def frame(spark, rows):
    """Rows of (doc_id, text) with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", 0, "r", "k", "n", "x", 1) for i, t in rows], SCHEMA)


LONG = "a line that is long enough to count"
LINES = [
    (1, f"{LONG}\nshort\nonly here, and long enough too"),
    (2, f"  {LONG.upper()}\t\nshort"),
    (3, f"{LONG}\n{LONG}\nÉcole à part, assez longue"),
    (5, f"x\n{LONG}\n{LONG} "),
    (6, None),
    (7, ""),
    (8, "école à part, assez longue"),
    (9, "\n\n"),
    (None, LONG),
    (None, "another line without any id at all"),
    (10, "y\n" * 3000 + LONG),
    (2, f"  {LONG.upper()}\t\nshort"),
]


def lines_by_hand(rows, min_chars=20, min_docs=3):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            ids = holders.get(key(line), set())
            top = max((x for x in ids if x is not None), default=None)
            if len(ids) < min_docs or i == top:
                kept.append(line)
        n = len((t or "").split("\n"))
        out.append((i, n, n - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    out = line_dedup.line_dedup(frame(spark, LINES))
    assert out.columns[:3] == ["doc_id", "text", "lang"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == lines_by_hand(LINES)
    assert any(n for _, _, n, _ in got)


def test_no_lines(spark):
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


BASE = "the quick  brown\tfox jumps over the lazy dog " * 3
EXACT = [
    (4, BASE), (2, BASE.replace("\t", " \n ")), (9, BASE.replace("  ", " ")), (3, " " + BASE), (7, BASE + "x"),
    (11, None), (12, ""), (13, " "), (14, "\t\n"), (None, BASE), (2, BASE), (20, "é" * 50), (21, "é" * 49), (22, BASE[:40] + BASE),
    (30, "ab" * 4000), (31, "ab" * 4000), (32, "ab" * 3999 + "ba"),
]


def exact_by_hand(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("clash", [False, True])
def test_exact(spark, clash):
    mark = (lambda c: [F.lit(1).cast("long"), F.char_length(c).cast("long")]) if clash else (lambda c: exact_dedup.digest(c))
    out = exact_dedup.exact_dedup(frame(spark, EXACT), block_chars=16, fingerprint=mark).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == exact_by_hand(EXACT)
    for sha, rows in itertools.groupby(sorted(out, key=lambda r: r.text_sha256), key=lambda r: r.text_sha256):
        kept = [r for r in rows if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") + str(rng.randrange(30)) for _ in range(n)]


def near_rows():
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(1000 + k, " ".join(w if rng.random() > 0.02 else "edit" + str(k) for w in base)) for k in range(40)]
    chain = words(rng, 100)
    for k in range(5):  # neighbours are similar, ends are not
        chain = chain[8:] + words(rng, 8)
        rows.append((2000 - k, " ".join(chain)))
    rows += [(k, " ".join(words(rng, rng.randrange(1, 60)))) for k in range(20)]
    rows += [(30, "one two"), (31, "ONE  two"), (32, "one two three"), (33, ""), (34, None), (35, " \t"), (None, " ".join(base)), (30, "one two"), (40, "é É"), (41, "É É")]
    rows.append((50, " ".join(words(rng, 3000))))
    return rows


def near_by_hand(rows):
    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_near(spark):
    rows = near_rows()
    out = near_dedup.near_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == near_by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert len({r.component_id for r in out}) < len(rows) - 30


def test_one_of_each_group(spark):
    rows = near_rows()
    left = near_dedup.one_per_group(frame(spark, rows))
    ids = [r.doc_id for r in left.collect()]
    groups = {}
    for i, n, c in near_by_hand(rows):
        if n:
            groups.setdefault(c, []).append(i)
    empty = sum(not (t or "").strip() for _, t in rows)
    assert left.columns == SCHEMA.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")
    assert len(ids) == len(groups) + empty
    assert set(groups) <= set(ids)


def test_near_of_nothing(spark):
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0
    assert near_dedup.near_dedup(frame(spark, [(1, None), (2, "")])).where("kept").count() == 2


@pytest.mark.parametrize(("stars", "small"), [(0, 0), (0, 1000), (1, 0), (2, 10), (5, 0)])
def test_every_way_gives_the_same_components(spark, stars, small):
    """One bucket of sets that all quote some passage: stars, pairs and rare shingles agree."""
    rng = random.Random(2)
    sets = [(i, sorted({*range(100, 100 + rng.randrange(6, 12)), *(rng.randrange(40) for _ in range(rng.randrange(8)))})) for i in range(80)]
    keys = spark.createDataFrame(sets, "cid bigint, keys array<bigint>")
    members = spark.createDataFrame([(7, i, len(s), rng.randrange(5)) for i, s in sets], "key bigint, cid bigint, n bigint, weight bigint")
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        both = len(set(x) & set(y))
        if 100 * both >= 70 * (len(x) + len(y) - both):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    found = {r.node: r.root for r in near_dedup.class_links(keys, members, 70, stars=stars, small=small).collect()}
    assert {i: found.get(i, i) for i, _ in sets} == {i: find(i) for i, _ in sets}
    assert 3 < len(set(map(find, root))) < 70


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked if find(x) != x} or got == {x: find(x) for x in linked}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    s = near_dedup.superminhash(np.concatenate([a, b]), np.array([400, 400]), 512)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.07
    tiny = near_dedup.superminhash(np.array([5, 5, 6], np.uint64), np.array([1, 2, 0]), 84)
    assert (tiny[0] < 2**63).all() and (tiny[2] == 2**64 - 1).all()
    assert near_dedup.miss_probability(0.75) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\né ", max_size=12)), max_size=6))
def test_words(texts):
    import pyarrow as pa

    raw, at = tokens.buffer_of(pa.array(texts, pa.string()))
    low = tokens.LOWER[raw]
    starts, ends, rows = tokens.word_spans(low, at)
    got = [(int(r), low[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows)]
    want = [(k, re.sub("[A-Z]", lambda m: m[0].lower(), w)) for k, t in enumerate(texts) for w in re.findall("[^\x20\x09-\x0d]+", t or "")]
    assert got == want
    keys = tokens.word_keys(low, starts, ends, piece=4)
    assert (keys == tokens.word_keys(low, starts, ends)).all()
    assert len(set(keys.tolist())) == len({w for _, w in want})


def test_block_links_are_a_forest(spark):
    """Three clusters of near copies under one key, none of them known: fewer links than components."""
    rng = random.Random(2)
    rows = []
    for cluster in range(3):
        core = [cluster * 10_000 + k for k in range(60)]
        rows += [(1, 1000 * cluster + m, 60, 1000 * cluster + m, sorted(rng.sample(core, 56) + [cluster * 10_000 + 100 + m * 4 + k for k in range(4)])) for m in range(300)]
    table = spark.createDataFrame(rows, "key bigint, cid bigint, n bigint, c bigint, keys array<bigint>")
    for block in (10_000_000, 6_000):
        links = near_dedup._block_links(table, 75, block).collect()
        parent = {r[1]: r[1] for r in rows}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in links:
            parent[top(r.a)] = top(r.b)
        groups = {}
        for x in parent:
            groups.setdefault(top(x), set()).add(x // 1000)
        assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
        if block > 1_000_000:
            assert len(links) == 897
        else:  # nine blocks on either side: below the components of each pair of blocks, not the square of a cluster
            assert len(links) < 9 * 9 * 2 * 100 * 2 and len(links) < 3 * 300 * 299 / 10
