"""Legacy ARC archives: writing, parsing, conversion to WARC, reading back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stage

# The field lines that the two versions of the ARC format declare.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard name space of URLs
NO_URL = "unknown:"


class BadArchive(ValueError):
    """An archive that does not follow its own declarations."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _member(data: bytes) -> bytes:
    """One record as a gzip member of its own, so that archives can be cut at records."""
    return gzip.compress(data, compresslevel=1, mtime=0)


# --- ARC ---------------------------------------------------------------------------------


def arc_header(version: int, name: str) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 tagworth\n{ARC_FIELDS[version]}\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {EPOCH:%Y%m%d%H%M%S} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, when: datetime, block: bytes) -> bytes:
    url = NO_URL if not url else "".join(f"%{ord(c):02X}" if c.isspace() and ord(c) < 128 else c for c in url)
    extra = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{url} 0.0.0.0 {when:%Y%m%d%H%M%S} text/html {extra}{len(block)}\n".encode() + block + b"\n"


def http_block(payload: bytes, page_id) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), the head as it is, and the payload."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return {}, block, b""
    fields = {}
    for line in block[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, block[: end + 4], block[end + 4 :]


def _exactly(stream: BinaryIO, n: int, what: str) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise BadArchive(f"{what}: {n} bytes are declared, {len(data)} are left")
    return data


def read_arc(stream: BinaryIO) -> Iterator[dict]:
    """Records of an ARC stream, by the header line that its version block declares.

    The version block names the fields of every later header line; the last is the length
    of the content that follows.  A record is ``seq, url, ip, date, type, block``.
    """
    first = stream.readline().decode("utf-8", "replace").split()
    if len(first) < 5 or not first[0].startswith("filedesc://"):
        raise BadArchive("no version block")
    block = _exactly(stream, int(first[-1]), first[0]).decode("utf-8", "replace").split("\n")
    version, names = int(block[0].split()[0]), block[1].split()
    if version not in ARC_FIELDS or names != ARC_FIELDS[version].split():
        raise BadArchive(f"version {version} with fields {names}")
    seq = 0
    while line := stream.readline():
        if not line.strip():  # records are set apart by empty lines
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if len(values) != len(names):
            raise BadArchive(f"record {seq}: {len(values)} fields, {len(names)} are declared")
        row = dict(zip(names, values))
        content = _exactly(stream, int(row["Archive-length"]), f"record {seq}")
        yield {"seq": seq, "url": row["URL"], "ip": row["IP-address"], "date": row["Archive-date"], "type": row["Content-type"], "block": content}
        seq += 1


# --- WARC --------------------------------------------------------------------------------


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def record_id(archive: str, seq: int) -> str:
    """The identifier that a legacy record lacks: the same for the same archive and place."""
    return f"urn:uuid:{uuid.uuid5(NAMES, f'{archive}#{seq}')}"


def warc_date(arc_date: str) -> str:
    return datetime.strptime(arc_date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def converted(archive: str, row: dict, refers_to: str | None, page: str | None = None) -> bytes:
    """The WARC record that says what an ARC record says.

    A revisit names the record it refers to and, in a field of its own, the page of that.
    """
    fields, head, payload = split_http(row["block"])
    out = {
        "WARC-Type": "revisit" if refers_to else "response" if fields else "resource",
        "WARC-Record-ID": f"<{record_id(archive, row['seq'])}>",
        "WARC-Date": warc_date(row["date"]),
        "WARC-Target-URI": row["url"],
        "WARC-IP-Address": row["ip"],
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload if fields else row['block'])}",
    }
    block = head if refers_to else row["block"]
    if refers_to:
        out |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
        out |= {} if page is None else {"X-Refers-To-Page": page}
    out |= {"WARC-Block-Digest": f"sha1:{payload_digest(block)}", "Content-Type": "application/http; msgtype=response" if fields else row["type"]}
    return warc_record(out, block)


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; digests are checked."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise BadArchive(f"not a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = _exactly(stream, int(fields["content-length"]), fields.get("warc-record-id", "record"))
        if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", payload_digest(block)):
            raise BadArchive(f"{fields.get('warc-record-id')}: the block digest differs")
        yield fields, block


# --- jobs --------------------------------------------------------------------------------


class _Rolling:
    """Archives of bounded size.  A file is known by the row that the task returns.

    Names are unique to the attempt, so a task that runs again never meets the files of a
    lost one; what no row names is never read.
    """

    def __init__(self, folder: str, suffix: str, limit: int, opening) -> None:
        self.folder, self.suffix, self.limit, self.opening = folder, suffix, limit, opening
        self.out = None
        self.done: list[tuple[str, int]] = []

    def write(self, make) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            store, path = _store(self.folder)
            self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
            self.size, self.n = 0, 0
            self._put(self.opening(self.name))
        self._put(make(self.name, self.size))
        self.n += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, data: bytes) -> None:
        data = _member(data)
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.n))
            self.out = None


def _opened(uri: str) -> BinaryIO:
    store, path = _store(uri)
    return gzip.GzipFile(fileobj=store.open_input_stream(path, compression=None, buffer_size=1 << 20), mode="rb")


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _folder(spark: SparkSession, label: str) -> str:
    folder = new_path(spark, label)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return folder


def write_arc(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", versions=(1, 2), limit: int = 64 << 20) -> DataFrame:
    """Pages as legacy archives in the shared folder, dealt over the versions in turn.

    Returns one row per archive: ``path, n_records``.
    """
    folder = _folder(pages.sparkSession, "arc")

    def run(batches):
        import pyarrow as pa

        archives = [_Rolling(folder, ".arc.gz", limit, lambda name, v=v: arc_header(v, name)) for v in versions]
        for k, row in enumerate(_rows(batches)):
            v = k % len(versions)
            block = http_block((row["html"] or "").encode(), row["page_id"])
            seconds = int(row["page_id"]) % 10**9 if str(row["page_id"]).isdigit() else 0
            archives[v].write(lambda name, at: arc_record(versions[v], name, at, row["url"], EPOCH + timedelta(seconds=seconds), block))
        for a in archives:
            a.close()
        done = [x for a in archives for x in a.done]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "n_records"])

    given = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return stage(given.mapInArrow(run, "path string, n_records bigint"), "arc-list")


def _dealt(archives: DataFrame) -> DataFrame:
    """One archive per task: as many ranges of paths as archives."""
    return archives.repartitionByRange(max(archives.count(), 1), "path")


def arc_index(archives: DataFrame) -> DataFrame:
    """What the records of ARC archives hold: place, identifier, page, length and digest."""

    def run(batches):
        import pyarrow as pa

        for row in _rows(batches):
            found = []
            with _opened(row["path"]) as stream:
                for r in read_arc(stream):
                    fields, _, payload = split_http(r["block"])
                    payload = payload if fields else r["block"]
                    found.append((row["path"], r["seq"], record_id(row["path"], r["seq"]), fields.get("x-page-id"), len(payload), payload_digest(payload)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = ["path", "seq", "record_id", "page_id", "payload_bytes", "digest"]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names)

    schema = "path string, seq bigint, record_id string, page_id string, payload_bytes bigint, digest string"
    return stage(_dealt(archives).mapInArrow(run, schema), "arc-index")


def arc_to_warc(archives: DataFrame, *, id_type: str = "bigint", min_bytes: int = 0, limit: int = 64 << 20) -> DataFrame:
    """ARC archives as WARC archives in the shared folder.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the
    largest page id is written whole, the others as revisits of it.  Returns one row per
    archive: ``path, n_records``.  Archives are parsed twice, once for the digests and
    once to be written; payloads are never shuffled, only their digests.
    """
    spark = archives.sparkSession
    index = arc_index(archives)
    order = F.struct(F.col("page_id").cast(id_type).alias("p"), F.col("record_id").alias("r"))
    firsts = stage(index.groupBy("digest", "payload_bytes").agg(F.max(order).alias("o")).select("digest", "payload_bytes", F.col("o.r").alias("first"), F.col("o.p").cast("string").alias("page")), "warc-first")
    again = (
        index.join(firsts, ["digest", "payload_bytes"])
        .where((F.col("payload_bytes") >= min_bytes) & (F.col("record_id") != F.col("first")))
        .groupBy("path")
        .agg(F.collect_list(F.struct("seq", "first", "page")).alias("again"))
    )
    work = stage(archives.select("path").join(again, "path", "left"), "warc-work")
    folder = _folder(spark, "warc")

    def opening(name: str) -> bytes:
        return warc_record(
            {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{record_id(name, -1)}>", "WARC-Date": f"{EPOCH:%Y-%m-%dT%H:%M:%SZ}", "WARC-Filename": name, "Content-Type": "application/warc-fields"},
            b"format: WARC File Format 1.0\r\n",
        )

    def run(batches):
        import pyarrow as pa

        for row in _rows(batches):
            refers = {x["seq"]: (x["first"], x["page"]) for x in row["again"] or ()}
            out = _Rolling(folder, ".warc.gz", limit, opening)
            with _opened(row["path"]) as stream:
                for r in read_arc(stream):
                    out.write(lambda name, at: converted(row["path"], r, *refers.get(r["seq"], (None, None))))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out.done], pa.string()), pa.array([x[1] for x in out.done], pa.int64())], ["path", "n_records"])

    return stage(_dealt(work).mapInArrow(run, "path string, n_records bigint"), "warc-list")


def warc_records(archives: DataFrame, *, id_type: str = "bigint") -> DataFrame:
    """Records of WARC archives: ``record_id, record_type, page_id, url, date,
    payload_bytes, payload_digest, refers_to_id, refers_to``.

    ``refers_to`` is the page that a revisit refers to, if the record says so.

    The payload digest of a whole record is computed anew and must be the declared one; a
    revisit has the declared digest and the length that its HTTP head states.
    """

    def run(batches):
        import pyarrow as pa

        for row in _rows(batches):
            found = []
            with _opened(row["path"]) as stream:
                for fields, block in read_warc(stream):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = split_http(block)
                    payload = payload if http else block
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and said != payload_digest(payload):
                        raise BadArchive(f"{fields['warc-record-id']}: the payload digest differs")
                    n = int(http.get("content-length", "0")) if kind == "revisit" else len(payload)
                    refers = fields.get("warc-refers-to")
                    found.append((fields["warc-record-id"].strip("<>"), kind, http.get("x-page-id"), fields["warc-target-uri"], fields["warc-date"], n, said, refers and refers.strip("<>"), fields.get("x-refers-to-page")))
            kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["record_id", "record_type", "page_id", "url", "date", "payload_bytes", "payload_digest", "refers_to_id", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names)

    schema = "record_id string, record_type string, page_id string, url string, date string, payload_bytes bigint, payload_digest string, refers_to_id string, refers_to string"
    out = _dealt(archives).mapInArrow(run, schema)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archived(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages written as legacy archives, converted to WARC and read back.

    Result, one row per page: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to`` (the page id of the whole record, for revisits), ``url, date``.

    A null html is an empty payload, and empty payloads count as equal ones.  A missing
    url is written as ``unknown:``; white space in a url is percent-encoded.  A missing
    page id is kept missing and is the smallest.  Of repeated rows one is whole and the
    others revisit it.  An empty table gives an empty result; further columns are not
    written.  A page is in memory as a whole, as its row is; archives are streamed.
    """
    id_type = pages.schema[page_id].dataType.simpleString()
    arcs = write_arc(pages, page_id=page_id, url=url, html=html)
    warcs = arc_to_warc(arcs, id_type=id_type, min_bytes=min_bytes)
    records = stage(warc_records(warcs, id_type=id_type), "warc-records")
    return records.select(F.col("page_id").alias(page_id), "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date")
