"""Fill-in-middle: the learned index and the forms against a version by hand."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tagworth.llm import fill_middle as fm


def by_hand(doc_id, text):
    t = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(w), "plain", None, None, t
    if h4 % 100 < 20:
        return len(w), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(w), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def rows():
    rng = random.Random(3)
    out = [(k, "".join(rng.choice(["word", "X", " ", "\n", "é", "東", "😀", "<P", "<S", ">", "<", "\x00"]) for _ in range(rng.randrange(0, 60)))) for k in range(300)]
    out += [(1000 + k, t) for k, t in enumerate(["", None, "a", " ", "<", "<P>", "x<M>y", "<S", ">", "a" * 200_000, " " * 200_000, "ab " * 70_000 + "c" * 50_000 + ". " * 9_000])]
    return out + [(None, "no id here"), (None, None), (7, out[7][1]), (7, out[7][1])]


def test_forms(spark):
    schema = "doc_id bigint, text string, fim_row int, fim_text int, n string, p int, form int, `a.b` int"
    docs = spark.createDataFrame([(*r, 1, 2, "n", 3, 4, 5) for r in rows()], schema)
    out = fm.fill_middle(docs)
    assert out.columns == ["doc_id", "text", "fim_row", "fim_text", "p", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fm.restored(out["output"], out["form"])).collect()
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(((i, t, *by_hand(i, t)) for i, t in rows()), key=str)
    assert all(r.back == (r.text or "") and r.p == 3 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fm.fill_middle(docs.limit(0)).count() == 0


def test_shares_of_forms(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text")
    forms = {r.form: r["count"] for r in fm.fill_middle(docs, fim_percent=50, spm_percent=50).groupBy("form").count().collect()}
    assert forms["plain"] == pytest.approx(2000, abs=150) and forms["spm"] == pytest.approx(1000, abs=120)


@pytest.mark.parametrize("error", [1, 8, 127])
def test_rank_index(error):
    """Lines keep their bound, residuals make every rank exact, and most of a text is few lines."""
    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, 500, 20_000]
    gaps = np.concatenate([[0], *[np.concatenate([[0], rng.integers(1, 12, n)]) for n in sizes]])[1:]
    offsets = np.cumsum(gaps)
    first = np.cumsum([0, *[n + 1 for n in sizes]])[:-1]
    index = fm.fit_ranks(offsets, first, error)
    ranks = np.arange(len(offsets))
    assert (index.lookup(ranks) == offsets).all()
    assert np.abs(index.predict(ranks) - offsets).max() <= error
    if error == 127:
        assert len(index.first) < 400
    assert len(fm.fit_ranks(np.zeros(0, np.int64), np.zeros(0, np.int64)).residual) == 0


def test_error_must_fit_a_byte(spark):
    with pytest.raises(ValueError):
        fm.fill_middle(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), error=128)
