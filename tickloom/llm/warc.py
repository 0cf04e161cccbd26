"""WARC archives: a writer with deduplicating revisit records and a splittable reader.

Writing.  Each task writes its rows as gzip members, one record a member, to files
of its own in a shared folder.  File names are unique for each attempt and only the
files in the returned manifest count, so a lost executor or a repeated task leaves
nothing but unlisted files behind.

Reading.  A task gets a byte range of a file and owns the records whose members
start inside it.  It scans for the gzip magic, validates each candidate by
decompressing its first bytes to a WARC version line and a complete header block,
and reads the last owned member beyond the range's end.  Damaged members are
stepped over by scanning on from the next byte.  A payload that itself holds a
compressed WARC can only mislead a scan if deflate stores it raw, which it does not
for text.

Nulls and edges: null html is an empty payload, a null url leaves the header out, a
null page_id is kept as null and counts as smaller than any other.  Equal page_ids
that tie for the largest are all responses.  Payloads may be of any length; one
record is held in memory at a time.  An empty table gives no files and no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.cluster import shared_path, written
from tickloom.llm.common import map_arrow

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
FILE_BYTES = 128 << 20
READ_BYTES = 1 << 20
MAX_HEADER = 1 << 20
#: Payloads below this many bytes are never replaced by a revisit.
REVISIT_BYTES = 1000
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, as the executors reach it."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def with_revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages with digest, size and the page that a revisit refers to (null for responses)."""
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    groups = (
        p.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1").select("digest", "first_id")
    )
    other = (F.col("n_bytes") >= min_bytes) & F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")))
    return p.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", "n_bytes", F.when(other, F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One uncompressed WARC record."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]-._~"))
    body = HTTP
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def written_files(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int = FILE_BYTES) -> Iterator[pa.RecordBatch]:
    """Write the rows of a task to files of its own in the folder (a URI or a local path); yields their manifest."""
    fs, root = filesystem(folder)
    out, name, size, n = None, "", 0, 0
    done: list[tuple[str, int, int]] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if out is None:
                fs.create_dir(root, recursive=True)
                name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = packer.compress(record(*row)) + packer.flush()
            out.write(member)
            size, n = size + len(member), n + 1
            if size >= file_bytes:
                out.close()
                done.append((f"{folder.rstrip('/')}/{name}", size, n))
                out = None
    if out is not None:
        out.close()
        done.append((f"{folder.rstrip('/')}/{name}", size, n))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "n_bytes", "n_records"])


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of :func:`with_revisits`; returns the manifest (path, n_bytes, n_records), paths with their scheme."""
    return map_arrow(pages, lambda batches: written_files(batches, folder, file_bytes), "path string, n_bytes long, n_records long")


class _Source:
    """A file read forward from a position; ``buf[pos:]`` is what has not been used yet."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.at, self.buf, self.pos, self.over = file, start, bytearray(), 0, False
        file.seek(start)

    def more(self) -> bool:
        got = b"" if self.over else self.file.read(READ_BYTES)
        self.over = not got
        self.buf += got
        return bool(got)

    def skip(self, n: int) -> None:
        """Go on by n bytes; what was used is dropped a few reads at a time, so that a byte is moved once at most."""
        self.pos, self.at = self.pos + n, self.at + n
        if self.pos >= 4 * READ_BYTES or self.pos > len(self.buf) // 2:
            del self.buf[: self.pos]
            self.pos = 0


def _member(source: _Source) -> tuple[dict[str, str], bytes, int] | None:
    """Header fields, block and compressed length of the member at the source's position; None if there is no valid one."""
    unzip, text, used, checked = zlib.decompressobj(31), [], 0, False
    while not unzip.eof:
        if source.pos + used >= len(source.buf) and not source.more():
            return None
        chunk = source.buf[source.pos + used : source.pos + used + 16384]
        try:
            plain = unzip.decompress(chunk)
        except zlib.error:
            return None
        used += len(chunk) - len(unzip.unused_data)
        text.append(plain)
        if not checked:
            head = b"".join(text)
            text = [head]
            if not head.startswith(b"WARC/1."[: len(head)]):
                return None
            checked = b"\r\n\r\n" in head
            if not checked and len(head) > MAX_HEADER:
                return None
    top, mark, rest = b"".join(text).partition(b"\r\n\r\n")
    if not mark or not top.startswith(b"WARC/1."):
        return None
    lines = top.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not fields.get("content-length", "").isdigit() or len(rest) < int(fields["content-length"]):
        return None
    return fields, rest[: int(fields["content-length"])], used


def records_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records whose members start in [start, end)."""
    source = _Source(file, start)
    while source.at < end:
        at = source.buf.find(MAGIC, source.pos)
        if at < 0:
            # a magic may straddle the end of what was read
            source.skip(max(0, len(source.buf) - source.pos - len(MAGIC) + 1))
            if not source.more():
                return
            continue
        source.skip(at - source.pos)
        if source.at >= end:
            return
        got = _member(source)
        if got is None:
            source.skip(1)
            continue
        offset = source.at
        source.skip(got[2])
        yield offset, got[0], got[1]


def splits(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row (path, start, end) for each byte range of the files in (path, n_bytes)."""
    n = F.greatest(F.ceil(F.col("n_bytes") / split_bytes), F.lit(1)).cast("long")
    ranges = files.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    return ranges.select("path", (F.col("k") * split_bytes).alias("start"), F.least((F.col("k") + 1) * split_bytes, F.col("n_bytes")).alias("end"))


RECORD_SCHEMA = "path string, offset long, record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to string, digest_ok boolean"


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of byte ranges (path, start, end), as RECORD_SCHEMA."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("digest_ok", pa.bool_())])
    for b in batches:
        for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fs, local = filesystem(path)
            rows = []
            with fs.open_input_file(local) as f:
                for offset, fields, block in records_in(f, start, end):
                    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, n = (hashlib.sha1(payload).hexdigest(), len(payload)) if kind == "response" else (stated, int(fields.get("x-payload-length", -1)))
                    rows.append((path, offset, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), n, digest, fields.get("warc-refers-to"), digest == stated if kind == "response" else None))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read(ranges: DataFrame) -> DataFrame:
    """One row for each record of the byte ranges, with the digest of what was read.

    ``digest_ok`` is false for a response whose payload does not have the digest
    that its header states; for a revisit, which has no payload, it is null.
    """
    return map_arrow(ranges, records, RECORD_SCHEMA)


def page_number(col: str):
    """The page_id in a record id, null if it has none."""
    return F.nullif(F.regexp_extract(col, r"^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = REVISIT_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write pages as WARC, read the archives back by byte ranges, one row for each record."""
    folder = shared_path(spark, "warc")
    manifest = written(write(with_revisits(pages, min_bytes), folder), "warc-manifest")
    ranges = splits(spark, manifest, split_bytes)
    n = max(1, ranges.count())
    return read(ranges.repartition(min(n, 10_000))).select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"), "digest_ok", "url"
    )
