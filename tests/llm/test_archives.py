"""Legacy archives: parsing by declaration, conversion, reading back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from tagworth.llm import warc

PAGES = [
    (1, "http://a.org/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a.org/", None), (4, "http://a.org/é", ""), (5, "u", "é" * 70_000),
    (6, "u", "\r\n\r\nWARC/1.0\r\nfiledesc://x"), (6, "u", "\r\n\r\nWARC/1.0\r\nfiledesc://x"), (None, "u", "<p>one</p>"), (7, "u", "line\n" * 1000),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1) for i, u, h in rows], "page_id bigint, url string, html string, path string, seq int")


def test_round_trip(spark):
    out = warc.archived(pages(spark, PAGES)).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in out), key=str)
    raw = [(i, (h or "").encode()) for i, _, h in PAGES]
    assert got == sorted(((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for i, b in raw), key=str)
    by_payload = {}
    for r in out:
        by_payload.setdefault(r.payload_digest, []).append(r)
    for rows in by_payload.values():
        whole = [r for r in rows if r.record_type == "response"]
        assert len(whole) == 1
        assert whole[0].page_id == max((r.page_id for r in rows if r.page_id is not None), default=None) and whole[0].refers_to is None
        assert all(r.refers_to == whole[0].page_id for r in rows if r.record_type == "revisit")
    assert {r.page_id: r.url for r in out}[1] == "http://a.org/x%20y" and {r.page_id: r.date for r in out}[5] == "2000-01-01T00:00:05Z"
    assert warc.archived(pages(spark, [])).count() == 0


def test_least_size(spark):
    out = warc.archived(pages(spark, PAGES), min_bytes=11).collect()
    assert {r.page_id for r in out if r.record_type == "revisit"} == {6}


@pytest.mark.parametrize("version", [1, 2])
def test_versions(version):
    block = warc.http_block(b"payload", 7)
    data = warc.arc_header(version, "a.arc") + warc.arc_record(version, "a.arc", 0, "http://x/", warc.EPOCH, block) + b"\n\n" + warc.arc_record(version, "a.arc", 9, None, warc.EPOCH, b"plain")
    rows = list(warc.read_arc(io.BytesIO(data)))
    assert [r["block"] for r in rows] == [block, b"plain"] and rows[1]["url"] == "unknown:" and rows[0]["date"] == "20000101000000"
    made = warc.converted("a.arc", rows[0], None) + warc.converted("a.arc", rows[1], None) + warc.converted("a.arc", rows[0], "urn:uuid:1")
    read = list(warc.read_warc(io.BytesIO(made)))
    assert [f["warc-type"] for f, _ in read] == ["response", "resource", "revisit"]
    assert read[0][0]["warc-record-id"] == f"<{warc.record_id('a.arc', 0)}>" and read[0][0]["warc-date"] == "2000-01-01T00:00:00Z"
    assert read[2][1].endswith(b"\r\n\r\n") and read[2][0]["warc-payload-digest"] == read[0][0]["warc-payload-digest"]


def test_broken_archives():
    good = warc.arc_header(1, "a") + warc.arc_record(1, "a", 0, "http://x/", warc.EPOCH, b"12345")
    for bad in (b"http://x/ 1 2\n", good[:-4], good.replace(b"text/html 5", b"text/html"), good.replace(b"Archive-length\n", b"Length\n")):
        with pytest.raises(warc.BadArchive):
            list(warc.read_arc(io.BytesIO(bad)))
    record = warc.warc_record({"WARC-Type": "resource", "WARC-Block-Digest": "sha1:A"}, b"x")
    with pytest.raises(warc.BadArchive):
        list(warc.read_warc(io.BytesIO(record)))


def test_members_are_records(spark):
    """Every record is a gzip member, so an archive can be cut at records."""
    listed = warc.write_arc(pages(spark, PAGES[:4])).collect()
    assert sum(r.n_records for r in listed) == 4
    for r in listed:
        raw = open(r.path.removeprefix("file://"), "rb").read()
        assert raw.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") == r.n_records + 1 and gzip.decompress(raw).startswith(b"filedesc://")
