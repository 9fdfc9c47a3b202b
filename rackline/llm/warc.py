"""Web archives: WARC records in ZIP packages, written and range-read by tasks.

A package holds one archive member (``archive/data.warc.gz``, each record a gzip member
of its own) and one index member (``indexes/index.cdx``), both stored, not compressed, so
that a record is a byte range of the package.  The reader takes the central directory
from the end of a package, with its ZIP64 forms, reads the index by its range, and then
reads records by theirs; nothing is extracted.

Packages live where pyarrow's file systems reach (local or mounted folders, HDFS, S3,
GCS); tasks open them by URI.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackline.llm.storage import Workspace, qualified

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdx"
LEAST_SHARED = 100
#: Bytes of records that one reading task fetches at a time, about.
READ_BYTES = 4 << 20

MANIFEST = "package string, records long"
ENTRIES = "package string, key string, start long, length long"


# Writing ---------------------------------------------------------------------------


def record(kind: str, url: str, key: str, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC/1.1 record about one HTTP response; a revisit carries its headers only."""
    digest = hashlib.sha256(payload).hexdigest()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if kind == "response" else http
    uri = " ".join((url or "").split()) or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + key)}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Page-Key: {key}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + refers_to)}>")
        lines.append(f"WARC-Refers-To-Key: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_package(folder: str, rows: Iterator[tuple], zip64: bool = True) -> tuple[str, int] | None:
    """Write one package of (page_id, url, html, refers_to) rows; its URI and record count.

    Every attempt of a task writes a file of its own name; only those named by the
    manifest, which Spark commits, are ever read.
    """
    first = next(rows, None)
    if first is None:
        return None
    where, root = fs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.wacz"
    entries, count, offset = [], 0, 0
    with where.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=zip64) as member:
            row = first
            while row is not None:
                page_id, url, html, refers_to = row
                payload = b"" if html is None else html.encode("utf-8")
                kind = "response" if refers_to is None else "revisit"
                first_key = None if refers_to is None else str(refers_to)
                packed = gzip_member(record(kind, url, str(page_id), payload, first_key))
                member.write(packed)
                entries.append(json.dumps([str(page_id), offset, len(packed)]))
                offset, count = offset + len(packed), count + 1
                row = next(rows, None)
        with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=zip64) as member:
            member.write("\n".join(entries).encode())
    return f"{folder}/{name}", count


def assign_revisits(pages: DataFrame, work: Workspace) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with the same payload, else null.

    Payloads of under 100 bytes and the smallest page itself have null.  Only digests that
    occur twice or more are joined back, first to rows without their html.
    """
    shareable = F.octet_length("html") >= LEAST_SHARED
    digest = F.when(shareable, F.sha2(F.encode("html", "UTF-8"), 256)).alias("digest")
    keyed = work.save(pages.select("page_id", digest).where("digest IS NOT NULL"), "digests")
    shared = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = work.save(shared.where("n > 1"), "shared")
    refers = keyed.join(shared, "digest").where("page_id <> first")
    refers = work.save(refers.select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "refers")
    rows = pages.select("page_id", "url", "html", digest).join(refers, ["page_id", "digest"], "left")
    return rows.select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, work: Workspace) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) as packages; the manifest (package, records).

    A null html is an empty payload, a null url ``about:blank``; page_id must not be null
    (such rows are written with the key ``None``).  One package per partition, so its size
    follows ``spark.sql.files.maxPartitionBytes`` and the shuffle partitions.
    """
    source = assign_revisits(pages, work)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
        )
        made = write_package(folder, rows)
        if made:
            yield pa.RecordBatch.from_pydict({"package": [made[0]], "records": [made[1]]})

    return work.save(source.mapInArrow(write, MANIFEST), "manifest")


# Reading ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    start: int
    length: int


def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"a package ends within the range {start}+{length}")
    return data


def members(file, size: int) -> list[Member]:
    """The members of a ZIP file of ``size`` bytes, from its central directory.

    Sizes, offsets and counts that don't fit 32 or 16 bits come from the ZIP64 records.
    """
    tail_length = min(size, 65_557)  # the end record and the longest comment
    tail = read_range(file, size - tail_length, tail_length)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != tail_length:
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP file")
    count, length, start = struct.unpack("<H I I", tail[at + 10 : at + 20])
    end = size - tail_length + at
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        locator = read_range(file, end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("a ZIP64 locator is missing")
        record_at = struct.unpack("<Q", locator[8:16])[0]
        big = read_range(file, record_at, 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("a ZIP64 end record is missing")
        count, length, start = struct.unpack("<Q Q Q", big[32:56])
    directory = read_range(file, start, length)
    found, p = [], 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is broken")
        method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
        packed, plain, names, extras, comments = struct.unpack("<I I H H H", directory[p + 20 : p + 34])
        header = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + names].decode("utf-8", "replace")
        extra = directory[p + 46 + names : p + 46 + names + extras]
        q = 0
        while q + 4 <= len(extra):
            kind, long = struct.unpack("<H H", extra[q : q + 4])
            if kind == 1:  # 64-bit values of the fields that are full, in this order
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[q + 4 : q + 4 + long - long % 8])]
                if plain == 0xFFFFFFFF:
                    plain = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if header == 0xFFFFFFFF:
                    header = wide.pop(0)
            q += 4 + long
        local = read_range(file, header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a local header is missing")
        skip = sum(struct.unpack("<H H", local[26:30]))
        found.append(Member(name, method, header + 30 + skip, packed))
        p += 46 + names + extras + comments
    return found


def open_package(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def index_entries(package: str) -> Iterator[tuple[str, int, int]]:
    """(key, start, length) of every record of a package; start counts from its first byte."""
    with open_package(package) as file:
        stored = {m.name: m for m in members(file, file.size()) if m.method == 0}
        if ARCHIVE not in stored or INDEX not in stored:
            raise ValueError(f"{package} lacks a stored archive or index")
        base = stored[ARCHIVE].start
        index = read_range(file, stored[INDEX].start, stored[INDEX].length)
    for line in io.BytesIO(index):
        key, start, length = json.loads(line)
        yield key, base + start, length


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case), and payload of one gzip member."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")

    def fields(lines: list[str]) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    warc = fields(head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("utf-8").split("\r\n")[1:]), payload


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the packages in ``manifest``.

    The index entries of all packages are dealt out by package and 4 MB stretch, so that
    a task reads neighbouring ranges of few files, and a large package is read by many.
    The digest of a response is that of the payload read; a revisit has no payload (null)
    and gives the digest and length in its headers.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                rows = list(index_entries(package))
                for i in range(0, len(rows), 10_000):
                    keys, starts, lengths = zip(*rows[i : i + 10_000], strict=True)
                    yield pa.RecordBatch.from_pydict(
                        {"package": [package] * len(keys), "key": keys, "start": starts, "length": lengths}
                    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
            ]
        )
        opened, file, rows, held = None, None, [], 0
        for batch in batches:
            for package, start, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if package != opened:
                    if file is not None:
                        file.close()
                    opened, file = package, open_package(package)
                warc, http, payload = parse_record(read_range(file, start, length))
                kind = warc["warc-type"]
                refers = warc.get("warc-refers-to-key")
                key = warc["warc-page-key"]
                rows.append(
                    (
                        None if key == "None" else int(key),
                        warc["warc-target-uri"],
                        kind,
                        None if refers is None else int(refers),
                        len(payload) if kind == "response" else int(http["content-length"]),
                        hashlib.sha256(payload).hexdigest()
                        if kind == "response"
                        else warc["warc-payload-digest"].removeprefix("sha256:"),
                        payload if payloads and kind == "response" else None,
                    )
                )
                held += len(payload) if payloads else 64
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if file is not None:
            file.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = manifest.select("package").repartition("package").mapInArrow(entries, ENTRIES)
    stretch = F.floor(F.col("start") / F.lit(READ_BYTES))
    dealt = found.repartition(F.col("package"), stretch).sortWithinPartitions("package", "start")
    return dealt.select("package", "start", "length").mapInArrow(records, RECORDS)


def package_folder(spark: SparkSession, path: str) -> str:
    """The URI, for pyarrow, of a folder that Spark writes to under ``path``."""
    uri = qualified(spark, path)
    return "file:///" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def archive_pages(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write ``pages`` to packages in the shared folder, and read the records back.

    Repeated rows give repeated records, an empty table none; a null page_id stays null and
    takes no part in revisits.  Extra columns are left out.
    """
    work = Workspace(pages.sparkSession, "warc")
    folder = package_folder(pages.sparkSession, work.path("packages"))
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    manifest = write_archives(pages, folder, work)
    return read_archives(pages.sparkSession, manifest, payloads)
