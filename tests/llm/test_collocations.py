"""Phrase collocations against a version by hand."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tagworth.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, min_count, top, longest=5, percent=100):
    n, f = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    f = {p: a for p, a in f.items() if a >= min_count}
    dropped = set()
    for p, a in f.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                inner = (p[0], *p[i : i + m])
                if 100 * a >= percent * f[inner]:
                    dropped.add(inner)
    out = []
    for lang in n:
        best = []
        for p, a in f.items():
            if p[0] == lang and len(p) > 2 and p not in dropped:
                cuts = [(1000 * a * n[lang] // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
                s, k = min(cuts)
                best.append((-s, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1 :])]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed=5, n=150):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "é", "東京", "a", "B", "run", "𝔘", "x" * 300]
    rows = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randrange(0, 40)):
            t += rng.choice(["New York City", rng.choice(words), rng.choice(words), "of the"]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ","])
        rows.append((t, rng.choice(["en", "en", "fr", None])))
    return [*rows, (None, "en"), ("", "zz"), (" \t ", "en"), ("ha " * 30_000, "de"), ("...", None), ("one two", "xx"), *rows[:3]]


def run(spark, rows, **settings):
    docs = spark.createDataFrame([(t, lang, 1, "x", 2) for t, lang in rows], "text string, lang string, c int, prefix string, key int")
    return sorted(tuple(r) for r in co.collocations(docs, **settings).collect())


@pytest.mark.parametrize(("min_count", "top", "percent"), [(4, 1000, 100), (2, 15, 100), (3, 1000, 60)])
def test_phrases(spark, min_count, top, percent):
    want = by_hand(texts(), min_count, top, percent=percent)
    assert len(want) > 10
    assert run(spark, texts(), min_count=min_count, top=top, subsume_percent=percent) == want


def test_few_bits_cost_work_only(spark):
    """Where nearly every bit is set, nothing is passed over and counts stay exact."""
    assert run(spark, texts(), min_count=4, bits=16) == by_hand(texts(), 4, 2000)


def test_nothing(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("a b", "en")]) == []
    with pytest.raises(ValueError):
        run(spark, [], max_words=1)


def test_equal_hashes_are_told_apart():
    key, a = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    at, c = co.counted(key, [a])
    assert sorted(zip(a[at].tolist(), key[at].tolist(), c.tolist())) == [(1, 7, 2), (1, 9, 1), (2, 7, 1)]
    at, c = co.counted(key, [a], np.array([5, 1, 6, 2]))
    assert sorted(zip(a[at].tolist(), key[at].tolist(), c.tolist())) == [(1, 7, 11), (1, 9, 2), (2, 7, 1)]


def test_gathered_counts():
    """Combined over slices while that helps, given out when it does not; nothing is lost."""
    rng = np.random.default_rng(0)
    for limit in (10, 100_000):
        held, got, want = co.Gathered(4, limit), Counter(), Counter()
        batches = []
        for _ in range(20):
            runs = [rng.integers(0, 5, 50).astype(np.uint64) for _ in range(3)]
            want.update(zip(*(r.tolist() for r in runs)))
            key = runs[0] * np.uint64(25) + runs[1] * np.uint64(5)
            at, c = co.counted(key, runs)
            held.add(key[at], [r[at] for r in runs], c)
            batches += list(held.batches())
        batches += list(held.batches(last=True))
        for b in batches:
            assert b.column("w4").null_count == len(b)
            for *w, c in zip(*(b.column(x).to_pylist() for x in ("w1", "w2", "w3", "c"))):
                got[tuple(w)] += c
        assert got == want and (len(batches) == 1 or limit == 10)
