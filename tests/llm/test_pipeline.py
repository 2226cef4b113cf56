"""The stages of the pipeline: columns, decisions and the whole run."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline as cp
from tagworth.llm.common import stage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark):
    from test_dedup import lines_by_hand, near_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == [
        "quality classifier", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding",
    ]
    out = [docs]
    for name, fn in cp.STAGES:
        out.append(stage(fn(spark, out[-1], SF), "test"))
    assert all(tuple(d.columns) == tuple(docs.columns) for d in out[:-1])
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in out[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [{i for i, _ in r} for r in rows]
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & ids[1]) >= 0.95 * len(good) and len(ids[1] - good) < len(ids[0] - good)
    assert sorted(rows[2]) == sorted((i, t) for i, _, _, t in lines_by_hand(rows[1]))
    assert ids[3] == {c for _, _, c in near_by_hand(rows[2])} and len(rows[3]) == len(ids[3])
    assert ids[4] <= ids[3] and len(ids[4]) >= 0.5 * len(ids[3])
    last = out[-1].collect()
    assert {r.doc_id for r in last} == ids[4] and all(r.round_trip for r in last)
    assert {r.doc_id: tuple(r.ids) for r in cp.run(spark, SF).collect()} == {r.doc_id: tuple(r.ids) for r in last}


ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t", "en", "a", 3), (3, " \n\t", "en", "a", 3), (None, "A text without an id, but with some words.", "en", "a", 9),
    (4, "word " * 40_000, "fr", "b", 5), (5, "The same text twice in the table, row by row.", "en", "a", 5), (5, "The same text twice in the table, row by row.", "en", "a", 5),
    (6, "東京 😀 \x00 ▁ é", None, "c", 1), (7, "x" * 100_000, "zz", None, 1),
]


@pytest.mark.parametrize("rows", [ODD, []])
@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, rows, k):
    """Nulls, empty and very long texts, repeated rows, no rows and clashing columns."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, ids string, topic string, t1 int, rid int, line string"
    docs = spark.createDataFrame([(*r, "k", "i", "t", 1, 2, "l") for r in rows], schema)
    out = cp.STAGES[k][1](spark, docs, SF).collect()
    if k in (1, 4):
        assert len(out) == len(rows)
    if k == 2 and rows:
        assert sorted((r.doc_id for r in out), key=str) == sorted([1, 2, 3, 3, None, 4, 5, 6, 7], key=str)
    if k == 4:
        assert all(r.round_trip for r in out if r.ids is not None)
