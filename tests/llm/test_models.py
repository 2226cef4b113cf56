"""The classifier, the encoder and the language model against brute force."""

from __future__ import annotations

import binascii
import inspect
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagworth.llm import lm_scoring, quality_kn
from tagworth.llm import sentencepiece_viterbi as sp
from tagworth.llm.common import Shared

needs_pieces = pytest.mark.skipif(not Path(sp.MODEL).exists(), reason="no vocabulary")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, ids string, rid int, base int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "k", "i", 1, 2) for i, t, lang in rows], SCHEMA)


# --- classifier --------------------------------------------------------------------------


def kn_by_hand(texts, order=4):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    seqs = [[0] * (order - 1) + quality_kn._symbols([t])[0][order - 1 :].tolist() for t in texts]
    counts = {order: Counter(tuple(s[i : i + order]) for s in seqs for i in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = {}
    for n, c in counts.items():
        of = Counter(c.values())
        n1, n2, n3, n4 = (float(of[k]) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else None
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 2.0, 3 - 4 * y * n4 / n3 if n3 else 3.0] if y is not None else [0.5, 1.0, 1.5]
        cuts[n] = [min(max(d, 0.05), k) for d, k in zip(raw, (1, 2, 3))] if y is not None else raw
    after = defaultdict(list)
    for c in counts.values():
        for g, k in c.items():
            after[g[:-1]].append(k)

    def p(g):
        if not g:
            return 1 / quality_kn.SYMBOLS
        n, ctx = len(g), after.get(g[:-1])
        if not ctx:
            return p(g[1:])
        d = cuts[n]
        back = sum(d[min(k, 3) - 1] for k in ctx) / sum(ctx)
        k = counts[n].get(g, 0)
        return ((k - d[min(k, 3) - 1]) / sum(ctx) if k else 0) + back * p(g[1:])

    return p


def test_kneser_ney(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["das", "haus", "Baum", "geht", "über", "1x"]) for _ in range(rng.randrange(1, 40))) + "." for _ in range(60)]
    model = quality_kn.kneser_ney(quality_kn.gram_counts(frame(spark, [(k, t, "de") for k, t in enumerate(texts)])))
    model = quality_kn.collected(model)
    table = np.concatenate(quality_kn.dense_shards(model))
    assert np.exp(table.astype(np.float64)).reshape(-1, quality_kn.SYMBOLS).sum(axis=1) == pytest.approx(1, abs=1e-4)
    p = kn_by_hand(texts)
    for g in list(itertools.islice(itertools.product(range(0, 64, 7), repeat=4), 0, None, 37)) + [(0, 0, 0, 4), (4, 1, 19, 36)]:
        at = ((g[0] * 64 + g[1]) * 64 + g[2]) * 64 + g[3]
        assert math.exp(table[at]) == pytest.approx(p(g), rel=1e-4)
    odd = ["das Haus", None, "", "\x00\x01 zz", "x" * 5000, "東京 😀"]
    out = quality_kn.scored(frame(spark, [(k, t, None) for k, t in enumerate(odd)]), Shared(spark, model, quality_kn._table)).collect()
    for r in out:
        s = [0, 0, 0, *quality_kn._symbols([r.text])[0][3:].tolist()]
        logs = [math.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)]
        assert r.n_events == len(logs) == len(r.text or "") + 1
        assert r.log_perplexity == pytest.approx(-sum(logs) / len(logs), rel=1e-4)


def test_classifier_separates(spark):
    rng = random.Random(3)
    syllables = ["ka", "ro", "mi", "ten", "sul", "ber", "an", "do"]

    def prose(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."

    good = [(k, " ".join(prose(8) for _ in range(10)), "en" if k % 3 else "fr") for k in range(400)]
    bad = [(1000 + k, " ".join(w + "$$$" for w in prose(60).split()), "en") for k in range(20)] + [(2000 + k, prose(60).upper() + "!!", None) for k in range(20)]
    docs = frame(spark, good + bad + [(3000, None, "en"), (3001, "", "fr"), (None, good[0][1], "en")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good[:300]] + [(i, 0, 0) for i, _, _ in bad[:5]] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in quality_kn.quality_scores(docs, labels, min_docs=50).collect()}
    assert sum(out[i].kept for i, _, _ in good[300:]) >= 95
    assert not any(out[i].kept for i, _, _ in bad) and not out[3000].kept and not out[3001].kept
    none = quality_kn.quality_scores(docs, labels.limit(0))
    assert none.where("kept").count() == len(good) + len(bad) + 1
    assert quality_kn.quality_scores(frame(spark, []), labels).count() == 0


# --- encoder -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(sp.load_pieces())


@pytest.fixture(scope="module")
def library():
    """SentencePiece itself, with the same pieces and scores as a unigram model."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(Path(sp.MODEL).read_bytes())
    model.trainer_spec.model_type = 1
    for p, (_, score, _) in zip(model.pieces, sp.load_pieces()):
        p.score = score
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@needs_pieces
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="ab the ▁é\n\t", max_size=80)), max_size=6))
def test_decoding_restores_every_text(pieces, texts):
    ids, counts = pieces.encode(texts)
    assert pieces.decode(ids, counts) == [t or "" for t in texts]
    assert counts.sum() == len(ids)


@needs_pieces
def test_as_the_library(pieces, library):
    rng = random.Random(8)
    syllables = ["tion", "the", "er", "ß", "é", "ing", "q", "上", "🙂", ".", ",", "0", "ou"]
    scores = {i: s for i, (_, s, _) in enumerate(sp.load_pieces())}
    lost = pieces.unknown
    same = 0
    for _ in range(300):
        t = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12)))
        ids, _ = pieces.encode([t])
        theirs = library.encode(t)
        same += ids.tolist() == theirs
        if ids.tolist() != theirs:  # of equal sums the library takes one by its rounding
            value = [sum(scores[i] for i in x if i > 258) for x in (ids.tolist(), theirs)]
            assert value[0] == pytest.approx(value[1], abs=1e-2)
    assert same > 280 and lost < min(scores.values())


@needs_pieces
def test_merges_as_the_library():
    """The other segmentation gives exactly the ids of the library's BPE mode."""
    sentencepiece = pytest.importorskip("sentencepiece")
    theirs, mine = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL), sp.Pieces(sp.load_pieces(), merges=True)
    rng = random.Random(8)
    syllables = ["tion", "the", "er", "ß", "é", "ing", "q", "上", "🙂", ".", "$$$", "0", "ou", "  ", "\n"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts += ["", "therefore" * 40, "x" * 300 + " ab$$$" * 40, "   "]
    ids, counts = mine.encode(texts)
    edges = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        assert ids[edges[k] : edges[k + 1]].tolist() == theirs.encode(t)
    assert mine.decode(ids, counts) == texts


@needs_pieces
def test_long_words_and_long_texts(pieces, library, monkeypatch):
    word = "therefore" * 12
    alone, _ = pieces.one_word(sp._cps("▁" + word))
    group, _ = pieces.viterbi(sp._cps("▁" + word)[None, :])
    assert alone.tolist() == group.tolist() == library.encode(word)
    text = ("many words  and   runs of spaces " * 40) + "x" * 500
    whole, _ = sp._encoded(pieces, [text])
    monkeypatch.setattr(sp, "SLICE", 100)
    parts, _ = sp._encoded(pieces, [text])
    assert whole.tolist() == parts.tolist()


@needs_pieces
def test_encoded_frames(spark, pieces):
    rows = [(1, "Hello wörld", "en"), (2, None, None), (3, "", "en"), (1, "Hello wörld", "en"), (None, " a\n\n b ▁ ", "xx"), (5, "long " * 30_000, "en")]
    docs = frame(spark, rows)
    back = sp.decode(sp.encode(docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r.doc_id, r.decoded) for r in back), key=str)
    assert {r.doc_id: r.ids for r in back}[2] is None and {r.doc_id: r.ids for r in back}[3] == []
    checked = sp.encoded_and_checked(docs).collect()
    assert {r.round_trip for r in checked if r.doc_id != 2} == {True} and sum(r.n_tokens for r in checked) == sum(len(r.ids or []) for r in back)
    assert sp.encode(frame(spark, [])).count() == 0


# --- language model ----------------------------------------------------------------------

needs_ranks = pytest.mark.skipif(not Path(lm_scoring.VOCABULARY).exists(), reason="no vocabulary")


def lm_rows():
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["Stone", "river", "walks", "under", "éclair", "x9", "the"]) for _ in range(rng.randrange(1, 90))), "en") for k in range(60)]
    return rows + [(100, None, "en"), (101, "", "en"), (102, "the THE The", "en"), (None, "only here", None), (1, rows[1][1], "en"), (103, "a  b c", "en"), (104, "w" * 5000, "en"), (105, "word " * 5000, "en")]


def base_by_hand(rows):
    def tokens(t):
        return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    held = [binascii.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _, _ in rows]
    c = Counter(w for (_, t, _), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t, _), h in zip(rows, held):
        w = tokens(t)
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return sorted(out, key=str)


@needs_ranks
@pytest.mark.parametrize("common", [3, 100_000])
def test_base_scores(spark, common):
    rows = lm_rows()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scoring.lm_scores(frame(spark, rows), common_words=common, rounds=1).collect()), key=str)
    for mine, hand in zip(got, base_by_hand(rows), strict=True):
        assert mine[:5] == hand[:5] and mine[5] == pytest.approx(hand[5], rel=1e-9)
        assert -math.inf < mine[6] < 0


@needs_ranks
def test_lm_of_nothing(spark):
    assert lm_scoring.lm_scores(frame(spark, []), rounds=1).count() == 0
    held = [i for i in range(50) if binascii.crc32(str(i).encode()) % 5 == 1][:2]
    out = lm_scoring.lm_scores(frame(spark, [(i, "some words", "en") for i in held]), rounds=1).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in out] == [(0, 0, 0.0)] * 2


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 2000).astype(float)
    classes = lm_scoring.Classes(counts)
    return lm_scoring.Attention(lm_scoring.Attention.start(classes.mass)), classes


def test_classes_are_a_distribution():
    _, classes = small_model()
    inside = np.bincount(classes.outputs, weights=10**classes.log10_inside, minlength=lm_scoring.OUTPUTS)
    assert inside == pytest.approx(1) and classes.inputs.max() == lm_scoring.INPUTS - 1


def test_every_place_is_scored_once_and_causally():
    """Window scores equal a place-by-place computation that sees the past alone."""
    model, classes = small_model()
    w = {n: x.astype(np.float64) for n, x in model.w.items()}
    rng = np.random.default_rng(2)
    at = np.concatenate([[0], np.cumsum([1, 5, 32, 33, 100])])
    ids = rng.integers(0, 1999, at[-1]).astype(np.int32)
    end = 1999
    got = lm_scoring.attention_scores(model, classes, ids, at, end)
    for r in range(5):
        seq = ids[at[r] : at[r + 1]]
        inputs = classes.inputs[np.concatenate([[end], seq[:-1]])]
        total = 0.0
        for i, y in enumerate(seq):
            start = 0 if i < lm_scoring.CONTEXT else ((i - (lm_scoring.CONTEXT - lm_scoring.STRIDE)) // lm_scoring.STRIDE) * lm_scoring.STRIDE
            h = w["emb"][inputs[start : i + 1]]
            a = (h @ w["k"]) @ (h[-1] @ w["q"]) / math.sqrt(lm_scoring.WIDTH) + w["far"][np.arange(len(h))[::-1]]
            a = np.exp(a - a.max())
            z = (a / a.sum()) @ (h @ w["v"]) + h[-1] @ w["skip"]
            logits = z @ w["out"] + w["bias"]
            p = np.exp(logits - logits.max())
            total += math.log10((p / p.sum())[classes.outputs[y]]) + classes.log10_inside[y]
        assert got[r] == pytest.approx(total, rel=1e-4)


def test_gradient():
    model, _ = small_model()
    rng = np.random.default_rng(4)
    x = rng.integers(0, lm_scoring.INPUTS, (3, lm_scoring.CONTEXT))
    y = rng.integers(0, lm_scoring.OUTPUTS, (3, lm_scoring.CONTEXT))
    scored = rng.random((3, lm_scoring.CONTEXT)) < 0.7
    _, g = model.gradient(x, y, scored)
    for name in model.w:
        where = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep, step = model.w[name][where], 2e-2
        model.w[name][where] = keep + step
        up, _ = model.gradient(x, y, scored)
        model.w[name][where] = keep - step
        down, _ = model.gradient(x, y, scored)
        model.w[name][where] = keep
        assert g[name][where] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4), name


@needs_ranks
def test_attention_learns_on_held_out_text(spark):
    """Held-out loss falls below that of subword counts alone, which is where training starts."""
    rng = random.Random(0)
    parts = [["alpha", "beta", "gamma", "delta"], ["uno", "dos", "tres", "cuatro"]]
    rows = [(k, " ".join(rng.choice(parts[k % 2]) for _ in range(300)), "en") for k in range(250)]
    docs = frame(spark, rows)
    trained = lm_scoring.lm_scores(docs, every=2, rounds=3).where("held_out").agg({"score": "sum"}).first()[0]
    start = lm_scoring.lm_scores(docs, every=2, rounds=0).where("held_out").agg({"score": "sum"}).first()[0]
    assert trained > 0.8 * start


@pytest.mark.parametrize("lengths", [[1], [33, 1, 5, 32, 40, 3000], [1544, 1545, 1536, 8]])
def test_gradient_steps_see_every_place_of_every_text_once(lengths):
    """As set for production: of short texts as of long ones, with the past that scoring sees."""
    every = inspect.signature(lm_scoring.lm_scores).parameters["every"].default
    at = np.concatenate([[0], np.cumsum(lengths)])
    ids, end = np.arange(at[-1], dtype=np.int32), int(at[-1])
    before, seen = {}, Counter()
    for x, y, scored in lm_scoring.batches_of(*lm_scoring.segments(ids, at, end), every, 0):
        for w in range(len(x)):
            for i in np.flatnonzero(scored[w]):
                seen[int(y[w, i])] += 1
                before[int(y[w, i])] = x[w, : i + 1].tolist()
    assert seen == Counter(range(end))
    for r in range(len(lengths)):
        seq = [end, *range(at[r], at[r + 1])]
        for i in range(lengths[r]):
            late = lm_scoring.CONTEXT - lm_scoring.STRIDE
            start = 0 if i < lm_scoring.CONTEXT else (i - late) // lm_scoring.STRIDE * lm_scoring.STRIDE
            assert before[int(at[r]) + i] == seq[start : i + 1]


@needs_ranks
def test_short_texts_teach_the_attention(spark):
    """At the production settings; a part of the windows leaves texts of one window out."""
    rng = random.Random(0)
    parts = [["alpha", "beta", "gamma", "delta"], ["uno", "dos", "tres", "cuatro"]]
    docs = frame(spark, [(k, " ".join(rng.choice(parts[k % 2]) for _ in range(10)), "en") for k in range(4000)])
    trained, start = (lm_scoring.lm_scores(docs, **x).where("held_out").agg({"score": "sum"}).first()[0] for x in ({}, {"rounds": 0}))
    assert trained > 0.72 * start


def full_model(seed=1):
    rng = np.random.default_rng(seed)
    classes = lm_scoring.Classes(rng.integers(0, 50, 2000).astype(float))
    return lm_scoring.Attention(classes.start()), classes, rng


def test_trees_start_at_the_counts_and_stay_a_distribution():
    model, classes, rng = full_model()
    paths = classes.paths(np.arange(2000))
    start = model.inside_scores(rng.normal(0, 1, (2000, lm_scoring.WIDTH)), paths)
    assert start == pytest.approx(classes.log10_inside * math.log(10), abs=1e-4)
    model.inside += rng.normal(0, 1, model.inside.shape).astype(np.float32)
    p = np.exp(model.inside_scores(np.tile(rng.normal(0, 1, lm_scoring.WIDTH), (2000, 1)), paths))
    assert np.bincount(classes.outputs, weights=p) == pytest.approx(1, abs=1e-4)


def test_gradient_of_subwords():
    model, classes, rng = full_model()
    model.inside += rng.normal(0, 0.3, model.inside.shape).astype(np.float32)
    x = rng.integers(0, lm_scoring.INPUTS, (3, lm_scoring.CONTEXT))
    ids = rng.integers(0, 2000, x.shape)
    scored = rng.random(x.shape) < 0.7
    given = (x, classes.outputs[ids], scored, classes.paths(ids[scored]))
    _, g = model.gradient(*given)
    dense = np.zeros_like(model.inside)
    dense[g["nodes"]] = g["inside"]
    for name, values, slope in [("inside", model.inside, dense), *((n, model.w[n], g[n]) for n in model.w)]:
        where = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        keep, step = values[where], 2e-2
        values[where] = keep + step
        up, _ = model.gradient(*given)
        values[where] = keep - step
        down, _ = model.gradient(*given)
        values[where] = keep
        assert slope[where] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4), name


def test_context_tells_subwords_of_a_class_apart():
    """The past decides between two subwords of one class."""
    counts = np.full(2000, 10.0)
    classes = lm_scoring.Classes(counts)
    tail = np.flatnonzero(classes.outputs == lm_scoring.OUTPUTS - 1)[:2]
    a, b = np.flatnonzero(classes.inputs < 2)[:2]
    text = np.array([a, tail[0], b, tail[1]] * 8, dtype=np.int32)
    model, end = lm_scoring.Attention(classes.start()), 1999
    rows = lm_scoring.segments(np.tile(text, 64), np.arange(0, 64 * 32 + 1, 32), end)
    for turn in range(40):
        model.train((classes.inputs[x], classes.outputs[y], s, classes.paths(y[s])) for x, y, s in lm_scoring.batches_of(*rows, 1, turn))
    # with the classes alone known exactly, the counts inside would leave
    left = classes.log10_inside[text].sum()
    assert lm_scoring.attention_scores(model, classes, text, np.array([0, 32]), end)[0] > 0.5 * left


def test_scores_stay_finite_where_all_outputs_are_small():
    """What all outputs and all places have in common cancels, whatever its size."""
    model, classes = small_model()
    ids, at = np.arange(200, dtype=np.int32), np.array([0, 200])
    expected = lm_scoring.attention_scores(model, classes, ids, at, 1999)
    for shift in (-200, 200):
        model.w["bias"] += shift
        model.w["far"] += shift
        assert lm_scoring.attention_scores(model, classes, ids, at, 1999) == pytest.approx(expected, rel=1e-4)
        model.w["bias"] -= shift
        model.w["far"] -= shift


def test_a_training_step_costs_little_more_than_its_products():
    """Against its largest products alone: 2.5 times as long, 4.8 with row maxima, more exponentials and sums by sorted key."""
    np.empty(1 << 24, dtype=np.uint8)  # freed at once: from now on the process keeps memory of this size
    model, classes, rng = full_model()
    x = rng.integers(0, lm_scoring.INPUTS, (64, lm_scoring.CONTEXT))
    ids = rng.integers(0, 2000, x.shape)
    scored = np.tile(np.arange(lm_scoring.CONTEXT) >= lm_scoring.CONTEXT - lm_scoring.STRIDE, (64, 1))
    given = (x, classes.outputs[ids], scored)
    z = rng.normal(0, 1, (int(scored.sum()), lm_scoring.WIDTH)).astype(np.float32)
    out, a = model.w["out"], rng.normal(0, 1, (64, lm_scoring.CONTEXT, lm_scoring.CONTEXT)).astype(np.float32)
    h = rng.normal(0, 1, (*x.shape, lm_scoring.WIDTH)).astype(np.float32)

    def products():
        d = np.exp(z @ out)
        return z.T @ d, d @ out.T, np.exp(a), *(np.matmul(a, h) for _ in range(6))

    def least(run):
        took = []
        for _ in range(60):
            start = time.perf_counter()
            run()
            took.append(time.perf_counter() - start)
        return min(took)

    assert least(lambda: model.gradient(*given)) < 3.7 * least(products)


def test_limits_come_from_all_trusted_texts(spark):
    """``train_rows`` bounds the model alone; a small language has its part of it and its own limits."""
    rng = random.Random(5)
    words = {"en": ["stone", "river", "walks"], "xx": ["qqzu", "zzoq", "uxqu"]}

    def text(lang):
        return " ".join(rng.choice(words[lang]) for _ in range(30))

    rows = [(k, text("en"), "en") for k in range(1000)] + [(2000 + k, text("xx"), "xx") for k in range(60)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id bigint, quality int")
    good = spark.createDataFrame([(i, lang) for i, _, lang in rows], "trusted_id bigint, lang string")
    ids = {r[0] for r in quality_kn.training_ids(good, 200).collect()}
    assert len(ids) == 200 and sum(i >= 2000 for i in ids) == 60
    assert quality_kn.training_ids(good, 2000).count() == len(rows)
    out = quality_kn.quality_scores(docs, labels, train_rows=20, tail=0.05, min_docs=50).collect()
    for first, last, lang in ((0, 2000, "en"), (2000, 3000, "xx")):
        own = [r for r in out if first <= r.doc_id < last]
        n = [len(r.text) + 1 for r in own]
        assert abs(sum(r.z * math.sqrt(k) for r, k in zip(own, n)) / sum(n)) < 1e-6, lang  # the mean is that of all
        lo, hi = np.quantile([r.z for r in own], [0.05, 0.95])
        assert [r.kept for r in own if min(abs(r.z - lo), abs(r.z - hi)) > 2e-3] == [lo <= r.z <= hi for r in own if min(abs(r.z - lo), abs(r.z - hi)) > 2e-3]


def test_symbols_of_all_planes():
    from tagworth.llm.quality_kn import SYMBOLS, _symbols, symbol_of, symbol_table

    symbols, _ = _symbols(["a\U00020000\U0001d7cf\U0001d400\U0001f600￿"])
    assert symbols[3:9].tolist() == [1, 34, 35, 28, SYMBOLS - 1, SYMBOLS - 1]  # ideograph, digit, capital, emoji
    table = symbol_table()
    assert len(table) == 1 << 16 and all(table[cp] == symbol_of(cp) for cp in (65, 97, 233, 0x4E00, 0x3B1))


def test_model_reads_every_trusted_text(spark, monkeypatch):
    """However many documents are labelled good: no row, repeated id or language is left out, also in several passes."""
    seen, counted = [], quality_kn.gram_counts

    def watched(texts):
        seen.append(texts.count())
        return counted(texts)

    monkeypatch.setattr(quality_kn, "gram_counts", watched)
    docs = spark.range(150_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionAll(docs.where("doc_id < 10"))
    labels = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 < 8).cast("int").alias("quality"))
    quality_kn.quality_scores(docs, labels)
    assert seen == [120_008]
    texts, ids = docs.select(F.col("doc_id").alias("id"), "text").where("id < 3000"), quality_kn.good_ids(labels).where("trusted_id < 3000")
    whole = sorted(map(tuple, quality_kn.counts_of(texts, ids).collect()))
    monkeypatch.setattr(quality_kn, "IDS", 1000)
    assert sorted(map(tuple, quality_kn.counts_of(texts, ids).collect())) == whole
    assert len(seen) == 5 and sum(seen[2:]) == seen[1] == 2408
