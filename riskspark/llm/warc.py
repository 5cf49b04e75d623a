"""WARC records in ZIP-packaged archives: a writer and a range reader.

A package is a ZIP with *stored* (uncompressed) members: ``archive/data.warc.gz``
holds one gzip member per record, ``indexes/index.cdx`` one line per record with
its place inside the archive member, sorted by the reversed host and path of its URL.
Described packages also hold ``pages/pages.jsonl`` (the responses) and
``datapackage.json`` (every member's path, size and SHA-256). The reader never
extracts a package: it reads the end-of-central-directory record (ZIP64 too), walks
the central directory, finds the stored members, reads the index and then
range-reads the records, neighbouring ones by one range of up to ``RANGE_BYTES``
(a larger record is a range of its own).

Tasks write packages into the shared folder under names that no other attempt
uses and return manifest rows; only packages of committed attempts are listed, so
a lost executor costs a retry and nothing else.

Defined cases: a null payload is empty. Among records with equal payloads of at
least ``min_revisit_bytes`` bytes, the one with the smallest key is the response
and the others revisit it (rows with that same key are responses too; rows with a
null key revisit if any key is known). Columns beyond the named ones are ignored.
A record larger than ``PACKAGE_BYTES`` ends the package that it stands in.
An empty table writes no package and reads back no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import shared_path, ship, stored, to_arrow

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PAGE_LIST, DESCRIPTOR = "pages/pages.jsonl", "datapackage.json"
RANGE_BYTES = 4 << 20        # neighbouring records are read by one range of at most this size
PACKAGE_BYTES = 16 << 20     # a package is closed once its archive member reaches this size
RECORD_SCHEMA = ("key long, url string, record_type string, refers_to long, payload_bytes long, "
                 "payload_digest string, package string, offset long, length long")

# Signatures of the ZIP format.
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = (b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- reading


class Package:
    """Random access to the stored members of a ZIP without extracting it.

    ``read(offset, length)`` and ``size`` are all it needs from the storage."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = dict(self.directory())
        self.places: dict[str, tuple[int, int]] = {}

    def directory(self) -> Iterator[tuple[str, tuple[int, int]]]:
        start = max(0, self.size - (22 + 65535))
        tail = self.read(start, self.size - start)
        at = tail.rfind(EOCD)
        if at < 0:
            raise ValueError("not a ZIP package: no end of central directory")
        count, length, offset = struct.unpack("<HII", tail[at + 10:at + 20])
        locator = tail[at - 20:at] if at >= 20 else b""
        if locator[:4] == LOCATOR64:
            # the 32-bit fields may be saturated: the ZIP64 record has the real ones
            place = struct.unpack("<Q", locator[8:16])[0]
            end64 = self.read(place, 56)
            if end64[:4] != EOCD64:
                raise ValueError("damaged ZIP64 end of central directory")
            count, length, offset = struct.unpack("<QQQ", end64[32:56])
        central = self.read(offset, length)
        p = 0
        for _ in range(count):
            if central[p:p + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            method, = struct.unpack("<H", central[p + 10:p + 12])
            packed, plain = struct.unpack("<II", central[p + 20:p + 28])
            n_name, n_extra, n_note = struct.unpack("<HHH", central[p + 28:p + 34])
            local, = struct.unpack("<I", central[p + 42:p + 46])
            name = central[p + 46:p + 46 + n_name].decode("utf-8")
            extra = central[p + 46 + n_name:p + 46 + n_name + n_extra]
            packed, local = self.wide(extra, plain, packed, local)
            if method == 0:
                yield name, (local, packed)
            p += 46 + n_name + n_extra + n_note

    @staticmethod
    def wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int]:
        """Replace saturated 32-bit fields by those of the ZIP64 extra block."""
        p = 0
        while p + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[p:p + 4])
            if kind == 1:
                values = [v for (v,) in struct.iter_unpack("<Q", extra[p + 4:p + 4 + n // 8 * 8])]
                if plain == 0xFFFFFFFF and values:
                    values.pop(0)
                if packed == 0xFFFFFFFF and values:
                    packed = values.pop(0)
                if local == 0xFFFFFFFF and values:
                    local = values.pop(0)
            p += 4 + n
        return packed, local

    def place(self, name: str) -> tuple[int, int]:
        """First byte and length of a stored member's data; its local header is read once."""
        if name in self.places:
            return self.places[name]
        if name not in self.members:
            raise KeyError(f"no stored member {name!r}")
        local, length = self.members[name]
        head = self.read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError("damaged local header")
        n_name, n_extra = struct.unpack("<HH", head[26:30])
        self.places[name] = local + 30 + n_name + n_extra, length
        return self.places[name]

    def ranged(self, name: str, offset: int, length: int) -> bytes:
        start, total = self.place(name)
        if offset < 0 or offset + length > total:
            raise ValueError("range outside the member")
        return self.read(start + offset, length)


def local_uri(path: str) -> str:
    """``file:/x`` (Hadoop's spelling) and plain paths as ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return path if "://" in path else "file://" + os.path.abspath(path)


def open_package(path: str) -> tuple[Package, object]:
    store, inner = fs.FileSystem.from_uri(local_uri(path))
    f = store.open_input_file(inner)

    def read(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    return Package(read, f.size()), f


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member holding a WARC record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head, if it has one."""
    if headers.get("Content-Type", "").startswith("application/http"):
        return block[block.index(b"\r\n\r\n") + 4:]
    return block


def spans(places: Iterable[tuple[int, int]], most: int = RANGE_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """``(start, length, places)`` of the ranges to read: places (offset, length) that
    follow each other without a gap share a range of at most ``most`` bytes."""
    start = end = 0
    inside: list[tuple[int, int]] = []
    for offset, length in sorted(places):
        if inside and (offset != end or offset + length - start > most):
            yield start, end - start, inside
            inside = []
        if not inside:
            start = offset
        inside.append((offset, length))
        end = offset + length
    if inside:
        yield start, end - start, inside


def read_package(path: str) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, payload, offset, length) of every record that the index names."""
    package, f = open_package(path)
    try:
        start, length = package.place(INDEX)
        entries = [json.loads(line.split(" ", 2)[2]) for line in package.read(start, length).decode("utf-8").splitlines()]
        for first, total, places in spans((int(e["offset"]), int(e["length"])) for e in entries):
            data = package.ranged(ARCHIVE, first, total)
            for at, n in places:
                headers, block = parse_record(data[at - first:at - first + n])
                yield headers, payload_of(headers, block), at, n
    finally:
        f.close()


# ---------------------------------------------------------------- writing


EPOCH = "1970-01-01T00:00:00Z"


def record_id(key, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{url}')}>"


def clean(value: str | None) -> str:
    """A header value without line breaks (a URL may hold anything)."""
    return " ".join((value or "").split())


# Fixed value: the response head that stands before a payload.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def make_record(key, url, payload: bytes, digest: str, size: int, refers_to, refers_to_url=None, date: str = EPOCH) -> bytes:
    """One gzip member. A response's block is an HTTP response whose body is the
    payload; a revisit has no block, its payload is that of ``refers_to``."""
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key, clean(url))),
               ("WARC-Date", date), ("WARC-Target-URI", clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("X-Record-Key", "" if key is None else str(key)), ("X-Payload-Length", str(size))]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(refers_to, clean(refers_to_url))),
                    ("WARC-Refers-To-Target-URI", clean(refers_to_url)), ("X-Refers-To-Key", str(refers_to))]
        block = b""
    else:
        headers.append(("Content-Type", "application/http; msgtype=response"))
        block = HTTP_HEAD.format(size).encode() + payload
    headers.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(text.encode("utf-8") + block + b"\r\n\r\n", 1, mtime=0)


def search_key(url: str) -> str:
    """The URL as indexes sort it: host labels reversed, then path and query, without
    spaces; what is no URL stands as it is."""
    try:
        u = urlsplit(url)
        host = u.hostname or ""
    except ValueError:
        u, host = None, ""
    key = f"{','.join(reversed(host.split('.')))}){u.path or '/'}{'?' + u.query if u.query else ''}" if host else url
    return key.lower().replace(" ", "%20") or "-"


def json_lines(rows: Iterable[dict]) -> bytes:
    return "".join(json.dumps(r) + "\n" for r in rows).encode("utf-8")


def descriptor(members: list[tuple[str, bytes]], date: str) -> bytes:
    """``datapackage.json``: the package's members with their sizes and hashes."""
    return json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "created": date, "resources": [
        {"name": os.path.basename(name), "path": name, "hash": f"sha256:{hashlib.sha256(data).hexdigest()}", "bytes": len(data)}
        for name, data in members]}, indent=1).encode("utf-8")


class PackageWriter:
    """Gathers records into packages of bounded size in ``folder``."""

    def __init__(self, folder: str, limit: int, date: str = EPOCH, described: bool = False):
        self.folder, self.limit, self.date, self.described = folder, limit, date, described
        self.reset()

    def reset(self) -> None:
        self.archive, self.lines, self.pages, self.offset = [], [], [], 0

    def add(self, key, url, record: bytes, digest: str = "", revisit: bool = False) -> dict | None:
        url = clean(url)
        entry = {"url": url, "mime": "warc/revisit" if revisit else "text/html", "digest": f"sha1:{digest}",
                 "offset": str(self.offset), "length": str(len(record)), "filename": os.path.basename(ARCHIVE)}
        stamp = "".join(c for c in self.date if c.isdigit())
        self.lines.append(f"{json.dumps(search_key(url))[1:-1]} {stamp} {json.dumps(entry)}\n")
        if self.described and not revisit:
            self.pages.append({"id": record_id(key, url)[len("<urn:uuid:"):-1], "url": url, "ts": self.date})
        self.archive.append(record)
        self.offset += len(record)
        return self.close() if self.offset >= self.limit else None

    def close(self) -> dict | None:
        if not self.lines:
            return None
        members = [(ARCHIVE, b"".join(self.archive)), (INDEX, "".join(sorted(self.lines)).encode("utf-8"))]
        self.archive = []
        if self.described:
            head = {"format": "json-pages-1.0", "id": "pages", "title": "All Pages"}
            members.append((PAGE_LIST, json_lines([head, *self.pages])))
            members.append((DESCRIPTOR, descriptor(members, self.date)))
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, data in members:
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                    member.write(data)
        path = f"{self.folder}/{uuid.uuid4().hex}.wacz"
        store, inner = fs.FileSystem.from_uri(local_uri(path))
        store.create_dir(os.path.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as f:
            f.write(buf.getbuffer())
        row = {"path": [path], "records": [len(self.lines)], "bytes": [buf.tell()]}
        self.reset()
        return row


MANIFEST = "path string, records long, bytes long"


def write_warc(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, date: str | None = None,
               described: bool = False) -> DataFrame:
    """Write ``key, url, payload, digest, payload_bytes, refers_to, refers_to_url``
    rows; returns the manifest (one row per package), stored so that it names committed
    tasks' packages only. ``date``: the records' time, by default that of the call, the
    same in every attempt of a task. ``described``: with the list of pages and the
    description of all members."""
    ship(records.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    schema = to_arrow(MANIFEST)

    def run(batches: Iterable[pa.RecordBatch]):
        out = PackageWriter(folder, package_bytes, date, described)
        for b in batches:
            for row in b.to_pylist():
                payload = (row["payload"] or "").encode("utf-8") if row["refers_to"] is None else b""
                record = make_record(row["key"], row["url"], payload, row["digest"], row["payload_bytes"], row["refers_to"],
                                     row["refers_to_url"], date)
                if done := out.add(row["key"], row["url"], record, row["digest"], row["refers_to"] is not None):
                    yield pa.RecordBatch.from_pydict(done, schema=schema)
        if done := out.close():
            yield pa.RecordBatch.from_pydict(done, schema=schema)

    return stored(records.mapInArrow(run, MANIFEST), "manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed packages. A response's digest and length
    are computed from the payload read; a revisit's are those in its headers."""
    ship(manifest.sparkSession)
    schema = to_arrow(RECORD_SCHEMA)

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                rows = []
                for headers, payload, offset, length in read_package(path):
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["X-Payload-Length"])
                    if kind == "response":
                        size = len(payload)
                        if digest32(payload) != digest:
                            raise ValueError(f"payload digest differs in {path} at {offset}")
                    key, ref = headers.get("X-Record-Key", ""), headers.get("X-Refers-To-Key")
                    rows.append((int(key) if key else None, headers.get("WARC-Target-URI"), kind,
                                 int(ref) if ref else None, size, digest, path, offset, length))
                    if len(rows) >= 2000:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    # packages are bounded units of work: spread them over all tasks
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(width, "path").mapInArrow(run, RECORD_SCHEMA)


def base32_of_hex(hex_sha1):
    """Upper-case base32 of a hex SHA-1 column: five hex digits are four letters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(8):
        v = F.conv(F.substring(hex_sha1, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(alphabet), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_revisit_bytes: int = 0) -> DataFrame:
    """Decide responses and revisits, then attach the payloads.

    Only (key, digest, length) is grouped, so a payload that a third of all pages
    share is combined map-side; payloads travel once, keyed by (key, digest)."""
    p = pages.select(pages[id_col].cast("long").alias("key"), pages[url_col].cast("string").alias("url"),
                     F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("sha", F.sha1(F.encode("payload", "UTF-8"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = (p.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("sha", "payload_bytes")
             .agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url"))).alias("f"), F.count("*").alias("n")).where("n > 1")
             .select(F.col("sha").alias("s"), F.col("payload_bytes").alias("b"), F.col("f.key").alias("first"), F.col("f.url").alias("first_url")))
    out = p.join(first, (F.col("sha") == F.col("s")) & (F.col("payload_bytes") == F.col("b")), "left")
    ref = F.when(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    # a revisit's payload is not needed any more: it is dropped before writing
    return out.select("key", "url", F.when(ref.isNull(), F.col("payload")).alias("payload"),
                      base32_of_hex(F.col("sha")).alias("digest"), "payload_bytes", ref.alias("refers_to"),
                      F.when(ref.isNotNull(), F.col("first_url")).alias("refers_to_url"))


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                    min_revisit_bytes: int = 0) -> DataFrame:
    """Write every page as a record of described packages, then read them all back."""
    spark = pages.sparkSession
    manifest = write_warc(plan_records(pages, id_col, url_col, payload_col, min_revisit_bytes),
                          shared_path(spark, "warc"), described=True)
    return read_warc(manifest)
