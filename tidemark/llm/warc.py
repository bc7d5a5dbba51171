"""WARC archives: a writer with revisit records, and a reader that splits compressed files by byte ranges.

Each record is one gzip member.  Spark's text writer stores the members: a row is a member without its last byte, and
the line separator is that byte.  A member ends with the length of its content, whose last byte is zero below
16 MiB; larger records are followed by an empty member, which ends so too.  Files are thus committed as any Spark
output, on any file system, and a part that is written again replaces the lost one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.staging import staged

MAGIC = b"\x1f\x8b\x08"
#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 0
#: Bytes of a file that one task owns.
RANGE_BYTES = 32 << 20
_READ = 1 << 20
_LOOK = 1 << 14
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def member(content: bytes) -> bytes:
    """``content`` as a gzip member that ends with a zero byte.

    Where the content itself holds the start of a member, the compressor is flushed in the middle of it, so that a
    stored block never shows those bytes to a reader that scans for members.
    """
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out, at = [], 0
    while (found := content.find(MAGIC, at)) >= 0:
        out += [packer.compress(content[at : found + 1]), packer.flush(zlib.Z_SYNC_FLUSH)]
        at = found + 1
    out += [packer.compress(content[at:]), packer.flush()]
    done = b"".join(out)
    return done if done[-1] == 0 else done + _EMPTY_MEMBER


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response which has it."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_REVISIT_PROFILE}"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = zip(*[part.column(i).to_pylist() for i in range(5)], strict=True)
            done = [member(record(i, url, (html or "").encode("utf-8", "surrogatepass"), first, bool(again)))[:-1] for i, url, html, first, again in rows]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``; null html is an empty payload.

    Of pages with equal payloads of at least ``least_revisit`` bytes, that with the smallest page_id is the response and the
    others revisit it.  Rows that repeat that page_id are responses too.  Pages without an id never are revisited; they
    are revisits if another page has their payload, else responses.  An empty table makes no record.

    Only payloads that occur more than once are joined, by digest; Spark splits one that very many pages have.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= least_revisit, F.sha1(F.col("html").cast("binary"))))
    groups = rows.where("sha IS NOT NULL").groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = staged(groups.where("n > 1 AND first IS NOT NULL").drop("n"), "warc-groups")
    joined = rows.join(groups, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    made = joined.select("page_id", "url", "html", "first", again.alias("again")).mapInArrow(_members, "member binary")
    # The bytes pass as a string: a cast doesn't look at them, and the writer puts them out as they are.
    made.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


class _Window:
    """Reads of a file from one place on, as far as asked; bytes before the current place are let go."""

    def __init__(self, handle, start: int, length: int):
        self.handle, self.start, self.length, self.data = handle, start, length, b""

    def at(self, place: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``place``, fewer only at the end of the file."""
        if place > self.start:
            cut = min(place - self.start, len(self.data))
            self.data = self.data[cut:]
            self.start = place
            if not self.data:
                self.handle.seek(place)
        while len(self.data) < size and self.start + len(self.data) < self.length:
            self.handle.seek(self.start + len(self.data))
            more = self.handle.read(max(size - len(self.data), _READ))
            if not more:
                break
            self.data += more
        return self.data[:size]


def _header(content: bytes) -> dict[str, str] | None:
    """Fields of a WARC header, if ``content`` begins with a whole one that has what each record must have."""
    end = content.find(b"\r\n\r\n")
    if end < 0 or not content.startswith(b"WARC/"):
        return None
    lines = content[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    good = {"warc-type", "warc-record-id", "content-length"} <= fields.keys() and fields["content-length"].isdigit()
    return fields | {"": str(end + 4)} if good else None


def _begins_record(window: _Window, place: int) -> bool:
    """Whether a member with a whole WARC header begins at ``place``.

    It is inflated as far as the header's end, wherever that is, or the member's, but no further than it looks like WARC.
    """
    unpack, head, at = zlib.decompressobj(31), bytearray(), place
    try:
        while not unpack.eof:
            data = window.at(at, _LOOK)
            if not data:
                return False
            at += len(data)
            while data and not unpack.eof:
                seen = max(len(head) - 3, 0)
                head += unpack.decompress(data, _LOOK)
                data = unpack.unconsumed_tail
                if not head.startswith(b"WARC/"[: len(head)]):
                    return False
                if head.find(b"\r\n\r\n", seen) >= 0:
                    return _header(bytes(head)) is not None
    except zlib.error:
        pass
    return False


def _inflate(window: _Window, place: int) -> tuple[bytes, int] | None:
    """Content of the member at ``place`` and where it ends; None if it is none."""
    unpack, out, at = zlib.decompressobj(31), [], place
    try:
        while not unpack.eof:
            data = window.at(at, _READ)
            if not data:
                return None
            out.append(unpack.decompress(data))
            at += len(data) - len(unpack.unused_data)
    except zlib.error:
        return None
    return b"".join(out), at


def _filesystem(path: str):
    """pyarrow's file system for a path as Spark names it, and the path within it."""
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(path).path if scheme else path
    return pafs.FileSystem.from_uri("s3" + path[len(scheme) :] if scheme in ("s3a", "s3n") else path)


def records_in(path: str, length: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, block) of the records that start in the bytes ``start`` to ``end`` (excluded) of one file.

    The range is searched for gzip's first bytes.  A place counts as a record's start if what is there inflates to a WARC
    header of any length; then the whole member is inflated, its check sum included, beyond the range's end if need be, and the search
    goes on behind it.  Members without a header, such as empty ones, are passed over; so are broken ones.
    """
    system, name = _filesystem(path)
    with system.open_input_file(name) as handle:
        window, place = _Window(handle, start, length), start
        handle.seek(start)
        while place < end:
            data = window.at(place, _READ + len(MAGIC) - 1)
            found = data.find(MAGIC)
            if found < 0:
                if len(data) < _READ:
                    return
                place += _READ
                continue
            place += found
            if place >= end:
                return
            # The look at the header keeps its bytes in the window: a wrong candidate costs no second read.
            peek = _Window(handle, place, length)
            peek.data = window.at(place, _READ)
            if not _begins_record(peek, place):
                place += 1
                continue
            peek = _Window(handle, place, length)
            peek.data = window.at(place, _READ)
            whole = _inflate(peek, place)
            if whole is None:
                place += 1
                continue
            content, after = whole
            header = _header(content)
            body = int(header.pop(""))
            yield place, header, content[body : body + int(header["content-length"])]
            place = after


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


_READ_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "block binary, file string, place long"
)


def _read(batches: Iterator[pa.RecordBatch], blocks: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "block", "file", "place"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    held: list[tuple] = []
    size = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for batch in batches:
        for path, length, start, end in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            for place, h, block in records_in(path, length, start, end):
                revisit = h["warc-type"] == "revisit"
                told = h.get("warc-payload-digest", "").removeprefix("sha1:")
                payload = int(h.get("x-payload-length", 0)) if revisit else len(block)
                held.append(
                    (
                        _page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], payload,
                        told if revisit else digest(block), _page(h.get("warc-refers-to")), block if blocks else None, path, place,
                    )
                )
                size += len(block)
                if len(held) >= 2048 or size > 8 << 20:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, blocks: bool = True) -> DataFrame:
    """Records of all WARC files under ``path``, one row each, with file and place.

    Spark lists the files and cuts their lengths into ranges; each task takes ranges and owns the records that start in
    them, so a file of any size is read by many tasks, and every record once.  Files are opened by pyarrow, which reads
    local and shared folders, hdfs, s3 and gs paths.  Digest and length of a response are computed from its payload;
    a revisit has those of its header.  ``blocks=False`` leaves payloads out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("length > 0").select("path", "length", starts.alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, F.col("length")))
    # Ranges are few and short rows, which adaptive execution would put into one task; here each gets its own.
    dealt = ranges.repartition(max(1, ranges.count()))
    return dealt.mapInArrow(partial(_read, blocks=blocks), _READ_SCHEMA)
