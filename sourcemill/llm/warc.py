"""WARC archives: a writer of one gzip member for each record and a splittable reader.

The reader deals byte ranges of the files to tasks.  A task scans its range for the
gzip magic, validates each candidate by inflating its start and decoding a WARC header,
and owns the records whose first byte lies inside its range, reading past the end of
the range where the last of them needs it.  A magic that turns up by chance inside
compressed data fails validation and is stepped over.  Files are read and written with
``pyarrow.fs``, so any file system it knows by URI can hold them; it must be one that
all executors share.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 100
SPLIT_BYTES = 32 << 20
_BLOCK = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_HEADER_LIMIT = 256 << 20
_DATE = "1970-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to=None, level: int = 6) -> bytes:
    """One WARC record as a gzip member."""
    block = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes one record for every row of pages under folder; returns path, records and bytes of each file.

    Of the records with equal payloads of at least min_revisit_bytes, those with the
    smallest page_id are responses, the others revisits of it; smaller payloads are
    always responses.  A null html is an empty payload, a null url leaves out the target,
    a null page_id leaves out the page header and is never referred to.  Repeated rows
    are written each; very long pages and urls are written whole; other columns,
    whatever their names, are not read; an empty table gives no file.  A file is written under a name of the attempt and then moved, so a
    task that runs again replaces it whole.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # Digests meet without their payloads; the payloads are then dealt by page and digest, so copies of one page spread.
    copies = rows.select("page_id", "digest").join(firsts.drop("n"), F.col("digest") == F.col("d"))
    refers = copies.where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), "d", F.col("first").alias("refers")).distinct()
    rows = rows.join(refers, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = _fs(folder)
        files.create_dir(base, recursive=True)
        path = f"{base}/part-{context.partitionId():06d}.warc.gz"
        draft = f"{base}/.{context.partitionId():06d}-{context.taskAttemptId()}"
        records = size = 0
        out = None
        for batch in batches:
            for page, target, body, digest, first in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                out = out or files.open_output_stream(draft)
                packed = record(page, target, body, digest, first)
                out.write(packed)
                records, size = records + 1, size + len(packed)
        if out:
            out.close()
            files.move(draft, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return rows.select("page_id", "url", "payload", "digest", "refers").mapInArrow(write, "path string, records long, bytes long")


class _Window:
    """Bytes of a file around a moving position."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.size, self.data = file, start, size, b""

    def at(self, position: int, n: int) -> bytes:
        """At least n bytes from position on, fewer only at the end of the file."""
        have = self.base + len(self.data)
        want = min(self.size, position + n)
        if position > have:
            self.base, self.data, have = position, b"", position
        if have < want:
            self.file.seek(have)
            self.data = self.data[max(0, position - self.base) :] + self.file.read(max(want - have, min(_BLOCK, self.size - have)))
            self.base = max(self.base, position)
        return memoryview(self.data)[position - self.base :]


def _headers(head: bytes) -> dict[str, str] | None:
    if not re.match(rb"WARC/1\.\d\r\n", head):
        return None
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out if {"warc-type", "content-length"} <= out.keys() and out["content-length"].isdigit() else None


def _member(window: _Window, position: int):
    """(length, headers, block) of the record at position, or None if there is no whole one."""
    unpack, parts, n, at, head = zlib.decompressobj(31), [], 0, position, None
    try:
        while not unpack.eof:
            piece = window.at(at, 1)[:_BLOCK]
            if not len(piece):
                return None
            # A little at first: most candidates fail here.
            piece = piece[: 1 << 12] if at == position else piece
            got = unpack.decompress(piece)
            at += len(piece) - len(unpack.unused_data)
            parts.append(got)
            n += len(got)
            if head is None:
                start = b"".join(parts)
                if not start.startswith(b"WARC/1."[: len(start)]):
                    return None
                end = start.find(b"\r\n\r\n")
                if end >= 0:
                    head = _headers(start[:end])
                    if head is None:
                        return None
                elif n > _HEADER_LIMIT:
                    return None
    except zlib.error:
        return None
    whole = b"".join(parts)
    end = whole.find(b"\r\n\r\n") + 4
    if head is None or len(whole) < end + int(head["content-length"]):
        return None
    return at - position, head, whole[end : end + int(head["content-length"])]


def records(path: str, start: int, end: int):
    """(offset, length, headers, block) of the records of a file that start in start..end."""
    files, path = _fs(path)
    with files.open_input_file(path) as file:
        window, at = _Window(file, start, file.size()), start
        while at < min(end, window.size):
            view = window.at(at, _BLOCK)
            found = bytes(view[: min(len(view), end - at + 2)]).find(_MAGIC)
            if found < 0:
                at += max(1, len(view) - 2)
                continue
            at += found
            if at >= end:
                return
            member = _member(window, at)
            if member is None:
                at += 1
                continue
            yield at, *member
            at += member[0]


def read_warc(spark: SparkSession, folder: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, offset, length, headers and payload of every record of the archives under folder.

    Only file names and sizes reach the driver.  headers is a map with lower-case names;
    payload is the body of the HTTP message, or the whole block if there is none.
    Damaged or cut members are left out; an empty or missing folder gives no row.
    """
    from pyarrow import fs

    files, base = _fs(folder)
    found = [i for i in files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)) if i.is_file and re.search(r"\.warc(\.gz)?$", i.path) and not i.base_name.startswith((".", "_"))]
    scheme = re.match(r"^([a-z][a-z0-9+.-]*://[^/]*)", folder)
    root = "" if not scheme or folder.startswith("file:") else scheme[1]
    splits = [(root + i.path if root else i.path, a, min(a + split_bytes, i.size)) for i in sorted(found, key=lambda i: i.path) for a in range(0, i.size, split_bytes)]
    schema = "path string, offset long, length long, headers map<string,string>, payload binary"
    arrow = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
    dealt = spark.createDataFrame(splits, "path string, first long, last long")
    if splits:
        dealt = dealt.repartition(min(len(splits), 100_000))

    def scan(batches):
        for batch in batches:
            for path, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                for offset, length, headers, block in records(path, first, last):
                    if headers.get("content-type", "").startswith("application/http") and b"\r\n\r\n" in block:
                        block = block.partition(b"\r\n\r\n")[2]
                    rows.append((path, offset, length, list(headers.items()), block))
                    size += len(block)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(scan, schema)


def page_records(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records read.

    Size and digest of a response come from the payload that was read, those of a
    revisit, which has none, from its header.
    """
    kind = F.col("headers")["warc-type"]
    stated = F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha256:", "")
    own = kind == "response"
    return found.select(
        F.try_element_at("headers", F.lit("x-page-id")).cast("long").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("headers")["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(stated).alias("payload_digest"),
        kind.alias("record_type"),
        F.try_element_at("headers", F.lit("x-refers-to-page")).cast("long").alias("refers_to"),
    )


def new_folder(shared: str) -> str:
    return f"{shared.rstrip('/')}/warc-{uuid.uuid4().hex}"


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.first IS NULL OR g.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.first <> page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
