"""Legacy archives (ARC, versions 1 and 2) and their conversion to WARC.

write_arc() lays pages down as ARC files, each with a version block first;
read_arc() parses them by the header line that their version declares and by
the declared lengths; write_warc() turns each ARC file into an equivalent WARC
file with synthesised identifiers, timestamps, types and digests; read_warc()
reads those. Files are gzipped and written and read through Spark's own
writers and readers, so any store will do.

A file is cut when its records hold FILE_BYTES, and a reading task holds one
file, so memory is bounded by FILE_BYTES and the longest page. Payloads are
never shuffled: which records revisit which is decided on digests and ids
alone, and each WARC file is made from its ARC file and that file's list of
revisits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, materialise, remove, remove_path, small_batches

#: Bytes of records in one file, before compression; a longer record has a file of its own.
FILE_BYTES = 16_000_000
#: Lists of revisits that are sent to all readers, in rows; more are joined with their files by a shuffle.
BROADCAST_REVISITS = 200_000
#: Parts into which the records of one payload are dealt.
PARTS = 32
#: The legacy archives need a fetch date, an address and a type; tables of pages have none.
DATE, ADDRESS, MIME = "20240101000000", "0.0.0.0", "text/html"
#: Fixed header lines of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str | None) -> str:
    """A URL without white space or controls; '-' for none."""
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "-"


def _http(page_id, payload: bytes) -> bytes:
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\n{mark}Content-Type: {MIME}; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()


_ID, _LENGTH = re.compile(rb"\r\nX-Page-Id: (-?\d+)\r\n"), re.compile(rb"\r\nContent-Length: (\d+)\r\n")


def _halves(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with the empty line that ends it, and payload."""
    end = block.index(b"\r\n\r\n") + 4
    return block[:end], block[end:]


def _page(head: bytes) -> int | None:
    found = _ID.search(head)
    return int(found[1]) if found else None


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 ctxloom\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} {ADDRESS} {DATE} text/plain {extra}{len(body)}\n".encode() + body


def arc_record(version: int, name: str, page_id, url: str | None, payload: bytes) -> bytes:
    """Without the line end that follows a record."""
    block = _http(page_id, payload) + payload
    extra = "" if version == 1 else f"200 {_digest(payload)} - 0 {name} "
    return f"{_safe(url)} {ADDRESS} {DATE} {MIME} {extra}{len(block)}\n".encode() + block


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: the fields that its version's header line names, in lower case, with offset and block. The version block isn't one of them."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode(errors="replace").rstrip("\r").split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} is shorter than it declares")
        if fields is None:
            if not values[0].startswith("filedesc://"):
                raise ValueError("an ARC file starts with its version block")
            version = int(block.split(b" ", 1)[0])
            names = block.split(b"\n")[1].decode()
            if version not in FIELDS or len(names.split()) != len(FIELDS[version].split()):
                raise ValueError(f"unknown ARC version {version}")
            fields = names.lower().split()
        else:
            if len(values) != len(fields):
                raise ValueError(f"header line at {at} has {len(values)} fields, its version {len(fields)}")
            yield dict(zip(fields, values)) | {"offset": at, "block": block}
        at = end + 1 + length


def _gzip_files(files: DataFrame, path: str, end: str) -> None:
    """One file a row of value. A writer's task sees each file as one record, so files are cut where their rows are."""
    lines = files.select(F.col("value").cast("string")).write.option("lineSep", end)
    lines.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", path: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Write pages as ARC files, versions in turn, and return the folder.

    Null html is an empty payload; null and odd URLs are written as '-' and
    percent-encoded; a null id has no id line. Rows that repeat have a record
    each, pages of any length are whole, other columns are not read, and an
    empty table gives files without records.
    """
    small_batches(pages.sparkSession)
    path = path or fresh_path(pages.sparkSession, "arc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size, out, version, name = TaskContext.get().partitionId(), 0, 0, [], 1, ""
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for page, link, text in zip(*(c.slice(start, 64).to_pylist() for c in batch.columns)):
                    if not out:
                        version, name = 1 + (part + n) % 2, f"pages-{part:05d}-{n:05d}.arc"
                        out, n = [version_block(version, name)], n + 1
                    out.append(arc_record(version, name, page, link, text or b""))
                    size += len(out[-1])
                    if size >= file_bytes:
                        yield _one(b"\n".join(out))
                        out, size = [], 0
        if out:
            yield _one(b"\n".join(out))

    rows = pages.select(F.col(id_col).cast("long"), F.col(url).cast("string"), F.col(html).cast("binary"))
    _gzip_files(rows.mapInArrow(run, "value binary"), path, "\n")
    return path


def _one(value: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])


def _plain(data: bytes) -> bytes:
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _converted(file: str, data: bytes) -> Iterator[tuple]:
    """Of each record of an ARC file: place, uid, page_id, WARC date, the ARC fields, head and payload.

    uid is a name-based UUID of file and offset, so another reading gives it again.
    """
    name = file.rsplit("/", 1)[-1]
    for r in parse_arc(data):
        head, payload = _halves(r["block"])
        d = r["archive-date"]
        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        yield r["offset"], str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{r['offset']}")), _page(head), date, r, head, payload


def read_arc(spark, path: str) -> DataFrame:
    """The records of ARC files without their blocks: file, at (the record's place in it), uid, page_id, payload_bytes, payload_digest.

    Records are as many as the files declare, empty payloads and repeated
    records included; a record shorter than its declared length, an unknown
    version or a header line with other fields than its version's is an error.
    """
    names = ["file", "at", "uid", "page_id", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _rows([(file, at, uid, page, len(payload), _digest(payload)) for at, uid, page, _, _, _, payload in _converted(file, _plain(content.as_py()))], names)

    return _files(spark, path).mapInArrow(run, "file string, at long, uid string, page_id long, payload_bytes long, payload_digest string")


_KINDS = {"at": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64()}


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS.get(n, pa.string())) for n, c in zip(names, columns)], names)


def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """file, at, refers_uid of the records that revisit another.

    Of records with equal payloads of at least `least` bytes, that with the
    smallest page_id (nulls last, then the smallest uid) is the response, the
    others revisit it. A payload that very many records share is dealt into
    PARTS parts, before it is counted and when its records meet the response.
    """
    of = F.struct(F.col("page_id").isNull().alias("o"), F.col("page_id").alias("p"), F.col("uid").alias("u"))
    long = records.where(F.col("payload_bytes") >= least).withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(PARTS)))
    parts = long.groupBy("payload_digest", "part").agg(F.min(of).alias("f"), F.count("*").alias("n"))
    first = parts.groupBy("payload_digest").agg(F.min("f").alias("f"), F.sum("n").alias("n")).where("n > 1").select("payload_digest", F.col("f.u").alias("refers_uid"))
    known = parts.select("payload_digest", "part").join(first, "payload_digest")
    return long.join(known, ["payload_digest", "part"]).where("uid <> refers_uid").select("file", "at", "refers_uid")


def warc_record(uid: str, date: str, arc: dict, head: bytes, payload: bytes, refers: str | None) -> bytes:
    """A response, or a revisit if it refers to one. Without the two line ends that follow a record."""
    block = head if refers else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <urn:uuid:{uid}>", f"WARC-Date: {date}", f"WARC-Target-URI: {arc['url']}",
        f"WARC-IP-Address: {arc['ip-address']}", f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"WARC-Block-Digest: sha1:{_digest(block)}",
    ]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def warcinfo(name: str) -> bytes:
    body = b"software: ctxloom\r\nformat: WARC File Format 1.1\r\nconformsTo: converted from ARC\r\n"
    uid = uuid.uuid5(uuid.NAMESPACE_URL, name)
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uid}>\r\nWARC-Date: {DATE[:4]}-{DATE[4:6]}-{DATE[6:8]}T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def write_warc(spark, arc: str, again: DataFrame, path: str | None = None) -> str:
    """Convert the ARC files in a folder, one WARC file each, and return the folder of these.

    again: the records that are revisits, as revisits() gives them; all others
    are responses, with their payloads whole. An ARC file without records
    becomes a WARC file without any, and repeated records stay repeated.
    """
    path = path or fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                refers = {r["at"]: r["refers_uid"] for r in listed.as_py() or ()}
                out = [warcinfo(file.rsplit("/", 1)[-1])]
                out += [warc_record(uid, date, fields, head, payload, refers.get(at)) for at, uid, _, date, fields, head, payload in _converted(file, _plain(content.as_py()))]
                yield _one(b"\r\n\r\n".join(out))

    # No more lists than files, and in a list no more entries than its file has records.
    listed = again.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("at", "refers_uid")).alias("again"))
    if again.count() <= BROADCAST_REVISITS:
        listed = F.broadcast(listed)
    _gzip_files(_files(spark, arc).join(listed, "path", "left").mapInArrow(run, "value binary"), path, "\r\n\r\n")
    return path


_LINE = re.compile(rb"\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of every record, by declared lengths."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at {at}")
        end = _LINE.search(data, at).start()
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:])}
        length = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def read_warc(spark, path: str) -> DataFrame:
    """Records of WARC files: uid, page_id, record_type, refers_uid, payload_bytes, payload_digest.

    A response's digest is checked against its payload; a record that has
    another is an error. Files without records, and repeated records, are fine.
    """
    names = ["uid", "page_id", "record_type", "refers_uid", "payload_bytes", "payload_digest"]
    urn = lambda v: v[len("<urn:uuid:") : -1] if v else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for fields, block in parse_warc(_plain(content.as_py())):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = _halves(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and _digest(payload) != digest:
                        raise ValueError(f"{fields['warc-record-id']}: the payload doesn't have the digest that is given")
                    length = int(_LENGTH.search(head)[1])
                    rows.append((urn(fields["warc-record-id"]), _page(head), fields["warc-type"], urn(fields.get("warc-refers-to")), length, digest))
                yield _rows(rows, names)

    return _files(spark, path).mapInArrow(run, "uid string, page_id long, record_type string, refers_uid string, payload_bytes long, payload_digest string")


def convert(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back: page_id, payload_bytes, payload_digest, record_type, refers_to (the page_id of the response).

    One row for each page; repeated rows have a record each, and the response
    is one of them. Null html is an empty payload; a null page_id is the
    response of its payload only if no other page has it, and refers_to is then
    null for revisits too. Pages of any length are whole; other columns are not
    read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, id_col=id_col, url=url, html=html, file_bytes=file_bytes)
    records = materialise(read_arc(spark, arc), "records")
    again = materialise(revisits(records, least), "revisits")
    warc = write_warc(spark, arc, again)
    back = materialise(read_warc(spark, warc), "back")
    for folder in (arc, warc):
        remove_path(spark, folder)
    remove(records), remove(again)
    response = back.where("record_type = 'response'")
    revisit = back.where("record_type = 'revisit'").withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(PARTS)))
    # Each response once for a part that refers to it.
    asked = revisit.select("refers_uid", "part").distinct()
    known = asked.join(response.select(F.col("uid").alias("refers_uid"), F.col("page_id").alias("refers_to")), "refers_uid")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisit.join(known, ["refers_uid", "part"], "left").select(columns))
