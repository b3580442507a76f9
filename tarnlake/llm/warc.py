"""WARC records inside ZIP archives, written once and read by range.

Writer: every partition becomes ZIPs of bounded size with two stored members, the
records (archive/data.warc) and their index (indexes/index.cdx: offset and length
of each). A slice of an index is what one task reads. Reader: finds the end record, follows the ZIP64 locator where there is
one, parses the central directory with its ZIP64 extra fields, locates stored
members by their local headers, reads the index and then each record by its
range. Nothing is extracted.

Defined cases: null html is an empty payload; null ids and urls have no header
and come back null; payloads under ``least`` bytes are never revisits; rows that
repeat a page_id share its role; equal payloads without any id are responses;
an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, workers_find_package, written

RECORDS, INDEX = "archive/data.warc", "indexes/index.cdx"
LEAST = 100  #: smallest payload, in bytes, that may become a revisit
ARCHIVE, SLICE = 1 << 30, 64 << 20  #: bytes of records after which an archive is closed, and that one reading task takes at a time
MAX_BROADCAST = 1_000_000  #: repeated digests (40 bytes each) that are sent to all executors


class ZipReader:
    """Central directory of a ZIP in a random-access file; range reads of its stored members."""

    def __init__(self, f, size: int):
        self.f, self.members = f, {}
        tail_at = max(0, size - 65_557)
        tail = self.at(tail_at, size - tail_at)
        k = tail.rfind(b"PK\x05\x06")
        while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(b"PK\x05\x06", 0, k)
        if k < 0:
            raise ValueError("no end of central directory: not a ZIP, or cut short")
        count, length, offset = struct.unpack_from("<HII", tail, k + 10)
        end = tail_at + k
        if end >= 20 and (locator := self.at(end - 20, 20))[:4] == b"PK\x06\x07":
            where = struct.unpack_from("<Q", locator, 8)[0]
            record = self.at(where, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points at no end record")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
        directory, p = self.at(offset, length), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, plain, n, x, c = struct.unpack_from("<IIHHH", directory, p + 20)
            local = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = directory[p + 46 + n : p + 46 + n + x], 0
            while q + 4 <= len(extra):
                kind, m = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # only the fields that overflow are there, in this order
                    r = q + 4
                    if plain == 0xFFFFFFFF:
                        plain, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                    if packed == 0xFFFFFFFF:
                        packed, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                    if local == 0xFFFFFFFF:
                        local = struct.unpack_from("<Q", extra, r)[0]
                q += 4 + m
            self.members[name] = (method, packed, local)
            p += 46 + n + x + c

    def at(self, offset: int, length: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(length)

    def data_offset(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        method, _, local = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.at(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no local header")
        return local + 30 + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        size = self.members[name][1]
        length = size - start if length is None else length
        if start < 0 or start + length > size:
            raise ValueError(f"{name}: the range is outside the member")
        return self.at(self.data_offset(name) + start, length)


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:x-page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(i) for i in range(33, 127) if chr(i) != '%'))}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload's digest is computed again and held against the header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this range")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    if h["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't have its digest")
    ident = lambda x: x and x.removeprefix("<urn:x-page:").removesuffix(">")
    return {
        "page_id": ident(h.get("warc-record-id")), "url": unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None, "payload": payload if h["warc-type"] == "response" else None,
        "payload_bytes": length, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": ident(h.get("warc-refers-to")),
    }


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html with digest, record_type and refers_to.

    Roles are learnt from ids and digests alone. Digests that occur twice are
    sent to all executors while they are at most MAX_BROADCAST, so that no page
    is shuffled; beyond that pages long enough to be a revisit are joined with
    them, and shorter ones still go by.
    """
    body = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"))
    long_enough = F.octet_length("html") >= least
    twice = written(
        narrow.where(long_enough).groupBy(F.unhex("digest").alias("twice")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull()).select("twice", "first_id"), "twice",
    )
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    role = ["page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to")]
    if twice.count() <= MAX_BROADCAST:
        return narrow.join(F.broadcast(twice), F.unhex("digest") == F.col("twice"), "left").select(*role)
    short = narrow.where(~long_enough).withColumn("first_id", F.lit(None).cast(dict(pages.dtypes)["page_id"]))
    return narrow.where(long_enough).join(twice, F.unhex("digest") == F.col("twice"), "left").select(*role).unionByName(short.select(*role))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, most: int = ARCHIVE, slice_bytes: int = SLICE) -> DataFrame:
    """(archive, at, length, records): the slices of the indexes of the ZIPs written. An archive is closed after `most` bytes of records. A retried task writes other files, and only the listed ones count."""
    workers_find_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        rows = (r for b in batches for r in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "record_type", "refers_to"))))
        number, row = 0, next(rows, None)
        if row is not None:
            fs.create_dir(base, recursive=True)
        while row is not None:
            name, at, slices, index = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.zip", 0, [], []
            line_at = begun = line_begun = n = 0
            with fs.open_output_stream(f"{base}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
                with z.open(RECORDS, "w", force_zip64=True) as out:
                    while row is not None and at < most:
                        page_id, url, page, digest, kind, refers = row
                        raw = record(page_id.as_py(), url.as_py(), page.as_py().encode(), digest.as_py(), kind.as_py(), refers.as_py())
                        out.write(raw)
                        line = b"%d %d\n" % (at, len(raw))
                        index.append(line)
                        at, line_at, n, row = at + len(raw), line_at + len(line), n + 1, next(rows, None)
                        if at - begun >= slice_bytes:
                            slices.append((line_begun, line_at - line_begun, n))
                            begun, line_begun, n = at, line_at, 0
                if n:
                    slices.append((line_begun, line_at - line_begun, n))
                z.writestr(INDEX, b"".join(index))
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slices)), *(pa.array([x[k] for x in slices], pa.int64()) for k in range(3))], ["archive", "at", "length", "records"])

    return written(roles(pages, least).mapInArrow(run, "archive string, at long, length long, records long"), "archives")


def read_archives(archives: DataFrame, folder: str, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """One row for each record of the listed index slices, each read by its range."""
    workers_find_package(archives.sparkSession)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, at_line, line_bytes in zip(*(b.column(c).to_pylist() for c in ("archive", "at", "length"))):
                path = f"{base}/{name}"
                with fs.open_input_file(path) as f:
                    z = ZipReader(f, fs.get_file_info(path).size)
                    begin, size = z.data_offset(RECORDS), z.members[RECORDS][1]
                    rows: list[dict] = []
                    held = 0
                    for line in z.read(INDEX, at_line, line_bytes).splitlines():
                        at, length = map(int, line.split())
                        if at + length > size:
                            raise ValueError("the index points outside the member")
                        rows.append(parse(z.at(begin + at, length)))
                        held += length if payloads else 256
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    n = max(1, archives.count())
    return (
        archives.select("archive", "at", "length").repartition(min(n, 8 * archives.sparkSession.sparkContext.defaultParallelism), "archive", "at").mapInArrow(run, schema)
        .withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
    )


def round_trip(pages: DataFrame, least: int = LEAST, payloads: bool = False, most: int = ARCHIVE, slice_bytes: int = SLICE) -> DataFrame:
    """Writes pages (page_id, url, html) into archives of the shared folder and reads every record back."""
    folder = new_path(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, least, most, slice_bytes)
    return read_archives(archives, folder, dict(pages.dtypes)["page_id"], payloads)
