"""WARC archives: a writer of one gzip member for each record, and a splittable reader.

The reader plans byte ranges, not files: a task scans its range for the gzip
magic, takes a candidate for a member if it inflates to a WARC header, and owns
the records that start inside its range, reading beyond its end where the last
of them does. Archives lie in any store pyarrow.fs opens by URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, stored

MAGIC = b"\x1f\x8b\x08"
SPLIT = 16 << 20
BLOCK = 1 << 20
#: Tasks of a read at most; further ranges are dealt over them.
MAX_TASKS = 20_000


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record as a gzip member. A revisit carries no payload."""
    body = payload if kind == "response" else b""
    uri = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: " + uri(page_id).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + (url or "").encode("utf-8", "replace").translate(None, b"\r\n"),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Payload-Length: " + str(len(payload)).encode(),
    ]
    if kind == "revisit":
        head += [b"WARC-Refers-To: " + uri(refers_to).encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: text/html", b"Content-Length: " + str(len(body)).encode()]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, payload, payload_digest, record_type, refers_to)
    as archives in folder; returns the manifest (path, n_bytes, n_records).

    Each task attempt writes a file of its own name, and only a finished
    attempt's name comes into the manifest, which is stored: files that a lost
    executor left are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        n_bytes = n_records = 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    system, base = _open(folder)
                    system.create_dir(base, recursive=True)
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None)
                data = record(r["page_id"], r["url"], r["payload"] or b"", r["payload_digest"], r["record_type"], r["refers_to"])
                out.write(data)
                n_bytes, n_records = n_bytes + len(data), n_records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [n_bytes], "n_records": [n_records]})

    cols = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    return stored(rows.select(*cols).mapInArrow(run, "path string, n_bytes bigint, n_records bigint"), "warc-manifest")


class _Window:
    """Bytes of a file by position, read in blocks as they are needed."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        end = min(pos + n, self.size)
        if pos < self.start or end > self.start + len(self.data):
            self.file.seek(pos)
            self.start, self.data = pos, self.file.read(max(n, BLOCK))
        return self.data[pos - self.start : end - self.start]


def _member(window: _Window, pos: int) -> tuple[bytes, int] | None:
    """The inflated member at pos and its end, or None if none with a WARC header begins there."""
    inflate, parts, at = zlib.decompressobj(31), [], pos
    while not inflate.eof:
        data = window.at(at, BLOCK // 16 if at == pos else BLOCK)
        if not data:
            if b"".join(parts[:1])[:5] == b"WARC/":
                raise ValueError(f"the member at {pos} is cut off")
            return None
        try:
            part = inflate.decompress(data)
        except zlib.error:
            return None
        parts.append(part)
        at += len(data)
        head = parts[0][:5]
        if len(head) == 5 and head != b"WARC/":
            return None
    body = b"".join(parts)
    return (body, at - len(inflate.unused_data)) if body[:5] == b"WARC/" and b"\r\n\r\n" in body else None


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields.get("content-length", 0))]


def _unchunked(body: bytes) -> bytes:
    """The data of a chunked transfer; what does not parse stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(fields: dict[str, str], content: bytes) -> bytes:
    """The payload of a record's content: what follows the head of an HTTP message, its chunks
    joined; the content itself of any other record."""
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return content
    head, gap, body = content.partition(b"\r\n\r\n")
    if not gap:
        return b""
    chunked = re.search(rb"^transfer-encoding:[^\r\n]*\bchunked\b", head, re.I | re.M)
    return _unchunked(body) if chunked else body


def _agrees(digest: str, fields: dict[str, str], content: bytes) -> bool:
    """Whether a payload digest (algorithm:value) is that of the payload, chunks joined or not;
    algorithms that are not known cannot disagree."""
    name, _, value = digest.partition(":")
    name = name.lower().replace("-", "")
    if not value or name not in ("sha1", "sha256", "sha512", "md5"):
        return True
    bodies = {payload_of(fields, content)}
    if fields.get("content-type", "").lower().startswith("application/http"):
        bodies.add(content.partition(b"\r\n\r\n")[2])
    for body in bodies:
        found = hashlib.new(name, body).digest()
        if value.rstrip("=").upper() == base64.b32encode(found).decode().rstrip("=") or value.lower() == found.hex():
            return True
    return False


def scan_range(uri: str, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, content) of the records that start in [start, end)."""
    system, path = _open(uri)
    with system.open_input_file(path) as file:
        window, pos = _Window(file, size), start
        while pos < end:
            data = window.at(pos, min(BLOCK, end - pos) + len(MAGIC) - 1)
            hit = data.find(MAGIC)
            if hit < 0:
                pos += max(1, len(data) - len(MAGIC) + 1)
                continue
            found = _member(window, pos + hit) if pos + hit < end else None
            if found is None:
                pos += hit + 1
                continue
            yield pos + hit, *parse(found[0])
            pos = found[1]


_RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def read(manifest: DataFrame, split: int = SPLIT, content: bool = True) -> DataFrame:
    """Records of the archives in manifest (path, n_bytes), by ranges dealt over MAX_TASKS tasks at most.

    Bytes that are no WARC member are passed over; an empty manifest gives no rows. A member
    that the file's end cuts off, or whose payload is not its digest's, is an error. Records
    of HTTP messages have the message's body as content and payload, and the digest keeps
    its algorithm's name unless that is SHA-1.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bytes") - 1, F.lit(split).cast("bigint")))
    ranges = manifest.filter("n_bytes > 0").select("path", "n_bytes", starts.alias("start"))
    ranges = ranges.repartition(min(MAX_TASKS, max(1, ranges.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("path", pa.string()), ("offset", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "target_uri", "payload_digest")), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                for offset, f, data in scan_range(r["path"], r["n_bytes"], r["start"], min(r["start"] + split, r["n_bytes"])):
                    digest = f.get("warc-payload-digest", "")
                    if f.get("warc-type") == "response" and not _agrees(digest, f, data):
                        raise ValueError(f"{r['path']} at {offset}: the payload differs from its digest")
                    digest, data = digest.removeprefix("sha1:"), payload_of(f, data)
                    rows.append({"path": r["path"], "offset": offset, "record_type": f.get("warc-type"), "record_id": f.get("warc-record-id"), "target_uri": f.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": int(f.get("x-payload-length", len(data))), "refers_to": f.get("warc-refers-to"), "content": data if content else None})
                    held += len(data)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return ranges.select("path", "n_bytes", "start").mapInArrow(run, _RECORD)


def missing(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(path, n_records, n_read): archives of which not as many records were read as written."""
    n = records.groupBy("path").agg(F.count("*").alias("n_read"))
    found = manifest.select("path", "n_records").join(n, "path", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))
    return found.filter("n_read <> n_records")


def revisits(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows for write(): of pages with equal payloads of at least least_bytes the
    one of the largest key is the response and the others revisit it.

    The largest key of each payload is a grouped maximum; it is stored, so that the
    join back is between two plain exchanges, and Spark splits a payload that
    a large part of the pages has. Null html is an empty payload. Rows that share
    the largest key are all responses.
    """
    base = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("__sha", F.unhex(F.sha1("payload")))
    first = base.groupBy("__sha").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").select(F.col("__sha").alias("__k"), "__first")
    first = stored(first, "payload-firsts")
    joined = base.join(first, F.col("__sha") == F.col("__k"), "left")
    again = (F.octet_length("payload") >= least_bytes) & F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    to_base32 = base32(F.col("__sha"))
    return joined.select("page_id", "url", "payload", to_base32.alias("payload_digest"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__first")).alias("refers_to"))


def base32(digest):
    """Upper-case base 32 of a 20-byte binary column, by arithmetic on its hex form."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(0, 40, 10):  # 5 bytes are 8 letters
        n = F.conv(F.substring(F.hex(digest), i + 1, 10), 16, 10).cast("bigint")
        parts += [F.substring(F.lit(letters), F.pmod(F.shiftright(n, 35 - 5 * k), F.lit(32)).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*parts)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives and return their manifest."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return write(revisits(pages, least_bytes), folder)


def page_of(column):
    """The page id of a record's URI; null where it has none."""
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records as read back from archives of pages."""
    return read(archive(pages, least_bytes=least_bytes))
