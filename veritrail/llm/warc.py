"""Legacy ARC archives to WARC, written to and read from shared storage."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder

#: Header fields of the two ARC versions (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_FROM = 1000
CAPTURED = "20240101000000"
RECORD_END = b"\r\n\r\n"
#: Compressed bytes after which a task begins a new file, about; a reader holds one file.
FILE_BYTES = 64 << 20
#: Bytes in a gzip member at most: below this the last byte of its length field is zero.
MEMBER_BYTES = (1 << 24) - 1
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space


def arc_archive(version: int, records: Iterable[tuple[str, str, bytes]], date: str = CAPTURED) -> bytes:
    """An ARC file of ``version`` from ``(url, content type, network document)``."""
    body = f"{version} 0 veritrail\n{ARC_FIELDS[version]}\n\n".encode()
    out = [_arc_line(version, "filedesc://veritrail.arc", "0.0.0.0", date, "text/plain", len(body)), body, b"\n"]
    for url, kind, document in records:
        out += [_arc_line(version, url, "0.0.0.0", date, kind, len(document)), document, b"\n"]
    return b"".join(out)


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int) -> bytes:
    url = _written(url)
    middle = "" if version == 1 else " 200 - - 0 veritrail.arc"
    return f"{url} {ip} {date} {kind}{middle} {length}\n".encode()


def _written(url: str) -> str:
    """An address as a header line can hold it: without white space, ``-`` for none."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"


def read_arc(data: bytes) -> Iterator[dict[str, str | bytes]]:
    """The records after the version block, each a dict of the header fields that the
    block declares, and ``document``. Bodies are cut by declared length alone, so what
    they hold can't be taken for a header; a wrong length or header raises ValueError."""
    stream = io.BytesIO(data)
    line = stream.readline().decode().rstrip("\n").split(" ")
    if not line[0].startswith("filedesc://"):
        raise ValueError("not an ARC file: no version block")
    block = stream.read(int(line[-1])).decode().split("\n")
    version, fields = int(block[0].split(" ")[0]), [*block, ""][1].split(" ")
    if ARC_FIELDS.get(version) != " ".join(fields):
        raise ValueError(f"unknown ARC version {version} or fields")
    stream.readline()
    while raw := stream.readline():
        if raw == b"\n":
            continue
        values = raw.decode().rstrip("\n").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"an ARC header of {len(values)} fields, not {len(fields)}")
        record: dict[str, str | bytes] = dict(zip(fields, values))
        length = int(values[-1])
        record["document"] = stream.read(length)
        if len(record["document"]) != length:
            raise ValueError("an ARC record ends before its declared length")
        yield record


def record_id(url: str, date: str, digest: str, head: bytes, more: str = "") -> str:
    """A name-based UUID of what an ARC record holds, so converting again gives the same one;
    ``more`` tells records apart that hold the same."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join([url, date, digest, hashlib.sha1(head).hexdigest(), more]))}>"


def _date(text: str) -> str:
    return f"{datetime.strptime(text, '%Y%m%d%H%M%S').replace(tzinfo=timezone.utc):%Y-%m-%dT%H:%M:%SZ}"


def warcinfo(name: str) -> bytes:
    """The record that a file opens with."""
    block = b"software: veritrail\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMES, name)}>", f"WARC-Date: {_date(CAPTURED)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + RECORD_END + block + RECORD_END


@dataclass(frozen=True)
class Original:
    """What a revisit refers to: the page, its address, and whether one record alone has them."""

    page_id: str
    url: str
    single: bool = True


def to_warc(record: dict, original: Original | None = None, more: str = "") -> bytes:
    """A WARC record with its trailing blank lines: a response, or, with ``original``, a revisit
    that has the HTTP headers alone and names the response by its identifier (if only one
    record can be meant), address and date."""
    document: bytes = record["document"]
    head, _, payload = document.partition(RECORD_END)
    digest, when = hashlib.sha1(payload).hexdigest(), record["Archive-date"]
    block = document if original is None else head + RECORD_END
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(record['URL'], when, digest, head, more)}",
        f"WARC-Date: {_date(when)}",
        f"WARC-Target-URI: {record['URL']}",
        f"WARC-IP-Address: {record['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if original.single:
            lines.append(f"WARC-Refers-To: {record_id(_written(original.url), when, digest, _head(original.page_id, len(payload)))}")
        lines += [f"WARC-Refers-To-Target-URI: {_written(original.url)}", f"WARC-Refers-To-Date: {_date(when)}", f"X-Refers-To-Page: {original.page_id}"]
    return "\r\n".join(lines).encode() + RECORD_END + block + RECORD_END


def member(record: bytes) -> bytes:
    """The record as a gzip member of its own (several, if it is very long) but for its last
    byte, which is zero and which the line-oriented writer adds as its separator."""
    made = [gzip.compress(record[at : at + MEMBER_BYTES], 6, mtime=0) for at in range(0, len(record), MEMBER_BYTES)]
    return b"".join(made)[:-1]


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each record of a binary stream, by declared length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record doesn't begin with its version")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            headers[key.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a WARC record ends before its declared length")
        yield headers, block


def revisits(pages: DataFrame, shortest: int = REVISIT_FROM) -> DataFrame:
    """``page_id, digest, refers_to, refers_url, single, repeats`` of pages that need more than
    their own row: those whose payload, of at least ``shortest`` bytes, a page of a larger id
    has as well, and rows that repeat an id and payload. Only ids, addresses and digests are
    shuffled; rows are aggregated first, and adaptive execution can split a hot digest."""
    html = F.coalesce("html", F.lit(""))
    light = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    one = light.groupBy("page_id", "digest").agg(F.max("url").alias("url"), F.max("n").alias("n"), F.count("*").alias("rows"))
    long = one.where(F.col("n") >= shortest)
    most = long.groupBy("digest").agg(F.max(F.struct("page_id", "url", "rows")).alias("m"), F.count("*").alias("ids")).where("ids > 1 and m.page_id is not null")
    most = most.select("digest", F.col("m.page_id").alias("refers_to"), F.col("m.url").alias("refers_url"), (F.col("m.rows") == 1).alias("single"))
    joined = one.join(most, "digest", "left").withColumn("again", F.col("refers_to").isNotNull() & (F.col("n") >= shortest) & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    rest = [F.when(F.col("again"), F.col(c)).alias(c) for c in ("refers_to", "refers_url", "single")]
    return joined.where("again or rows > 1").select("page_id", "digest", *rest, (F.col("rows") > 1).alias("repeats"))


def convert(pages: DataFrame, folder: str, shortest: int = REVISIT_FROM, file_bytes: int = FILE_BYTES) -> None:
    """Writes the pages as WARC files to ``folder``, a gzip member for each record, by way of ARC
    archives of both versions, which the converter takes apart again slice by slice (a few
    MB). A task begins a new file (folder ``part``) after ``file_bytes``, so that no file has
    to be larger than a reader's memory. The file system's writer is the engine's own, which
    commits whole tasks, so a lost executor leaves nothing half-written."""

    def run(batches):
        task = TaskContext.get().partitionId()
        version, part, written, n = 1, 0, file_bytes, 0
        for batch in batches:
            rows = [*zip(*(c.to_pylist() for c in batch.columns))]
            at = 0
            while at < len(rows):
                upto, size = at, 0
                while upto < len(rows) and size < 4_000_000:
                    size += len(rows[upto][2] or "")
                    upto += 1
                some, at, version = rows[at:upto], upto, 3 - version
                archive = arc_archive(version, ((url or "", "text/html", _http(i, html or "")) for i, url, html, *_ in some))
                out = []
                for record, (_, _, _, refers_to, refers_url, single, repeats) in zip(read_arc(archive), some, strict=True):
                    if written >= file_bytes:
                        part, written = part + 1, 0
                        out.append((member(warcinfo(f"{folder}/{task}/{part}")), part))
                    n += 1
                    original = None if refers_to is None else Original(refers_to, refers_url, single)
                    out.append((member(to_warc(record, original, f"{task} {n}" if repeats else "")), part))
                    written += len(out[-1][0])
                values, parts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(parts, pa.int32())], names=["value", "part"])

    again = revisits(pages, shortest).select(F.col("page_id").alias("id2"), F.col("digest").alias("digest2"), F.col("refers_to").cast("string").alias("refers_to"), "refers_url", "single", "repeats")
    own = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    joined = own.join(again, F.col("page_id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left")
    rows = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "refers_to", "refers_url", "single", "repeats")
    made = rows.mapInArrow(run, "value binary, part int").select(F.col("value").cast("string").alias("value"), "part")
    made.write.option("lineSep", "\x00").option("compression", "none").partitionBy("part").text(folder)


def _head(page_id: str | None, length: int) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {length}".encode()


def _http(page_id: str | None, html: str) -> bytes:
    body = html.encode("utf-8")
    return _head(page_id, len(body)) + RECORD_END + body


_READ = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def _any_file(spark, folder: str) -> bool:
    """Whether the archive has files; that of an empty table has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return any(s.isDirectory() for s in system.listStatus(path))


def read_back(spark, folder: str) -> DataFrame:
    """One row for each record of the archives: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``. A response's digest and length are taken from its payload and
    must agree with its headers; a revisit's are what its headers say."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for headers, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(RECORD_END)
                    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
                    if headers["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError("a payload differs from its digest or length")
                    found = re.search(rb"\r\nX-Page-Id: (\S+)", head)
                    out.append((found and found[1].decode(), size, digest, headers["warc-type"], headers.get("x-refers-to-page")))
                columns = [*zip(*out)] or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    if not _any_file(spark, folder):
        return spark.createDataFrame([], _READ)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("content")
    return files.mapInArrow(run, _READ)


def archive(pages: DataFrame, folder: str | None = None, shortest: int = REVISIT_FROM) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) to ``folder`` (a new shared one by default)
    and returns what :func:`read_back` finds, ids in the type of ``page_id``.

    Of equal payloads of at least ``shortest`` bytes the record with the largest page_id is
    a response and the others are revisits. A null html is an empty payload; a null url is
    written as ``-``; a null id is kept and never referred to unless all of a group are
    null, when all are responses. Rows that repeat an id and payload have the same type and
    identifiers of their own. An empty table makes an archive without records. Other columns
    aren't looked at. A record is one gzip member; payloads of 16 MB and more take several.
    Files carry the engine's names (``part-*``), not ``.warc.gz``.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    kind = pages.schema["page_id"].dataType
    convert(pages.select("page_id", "url", "html"), folder, shortest)
    return read_back(spark, folder).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
