"""WARC archives: a writer for pages and a reader that salvages damaged files.

Each record is a gzip member of its own. The archives are written by Spark's text writer, so a retried task leaves
no second file, and read back as whole binary files, whose size the writer bounds by records per file.

The reader checks every member (gzip checksum, version line, Content-Length, block digest). After a failed check
it looks for the next place where a valid member, or a version line of an uncompressed record, begins, goes on there,
and reports the bytes between as a quarantined gap."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import stored

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
RECORDS_PER_FILE = 2_000
#: An empty gzip member. The text writer ends each value with it, which keeps the file a valid gzip stream.
END_MEMBER = gzip.compress(b"", mtime=0)
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = ("path string, offset long, length long, record_type string, page_id string, url string, payload binary, payload_digest string, "
          "refers_to string, payload_bytes long, problem string")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, digest_of: str) -> bytes:
    """One record, uncompressed. A revisit has no block and names the page it refers to."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [
        VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest_of}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"X-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest_of}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict | None, int, str]:
    """The record at the start of `raw`, its length, and why it is not valid ('' if it is)."""
    cut = raw.find(b"\r\n\r\n")
    if not re.match(rb"WARC/1\.[01]\r\n", raw) or cut < 0:
        return None, 0, "no version line or header end"
    fields = {}
    for line in raw[:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, 0, "broken header line"
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None, 0, "no content length"
    end = cut + 4 + int(size)
    block = raw[cut + 4:end]
    if len(block) < int(size) or raw[end:end + 4] != b"\r\n\r\n":
        return None, 0, "block cut short"
    if fields.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        return None, 0, "block digest differs"
    return fields | {"block": block}, end + 4, ""


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(offset, length, record, problem) for each record and each gap of one archive, in order.

    A record has problem ''; a gap has no record. All bytes are in exactly one record or gap, but for the empty
    members between records."""
    at, gap, why = 0, -1, ""
    view = memoryview(data)
    while at < len(data):
        found, end, problem, empty = None, at, "unknown bytes", False
        if data.startswith(END_MEMBER, at):
            end, empty = at + len(END_MEMBER), True
        elif data.startswith(MAGIC, at):
            content, end, problem = _member_at(view, at)
            if content is not None:
                found, used, problem = parse(content)
                if found is not None and used != len(content):
                    found, problem = None, "bytes after the record"
        elif START.match(data, at):
            found, used, problem = parse(bytes(view[at:_plain_end(data, at)]))
            end = at + used
        if found is not None or empty:
            if gap >= 0:
                yield gap, at - gap, None, why
                gap = -1
            if found is not None:
                yield at, end - at, found, ""
            at = end
            continue
        if gap < 0:
            gap, why = at, problem
        following = START.search(data, at + 1)
        at = following.start() if following else len(data)
    if gap >= 0:
        yield gap, len(data) - gap, None, why


def _plain_end(data: bytes, at: int) -> int:
    """Where an uncompressed record that begins at `at` says it ends; the whole rest if it says nothing."""
    cut = data.find(b"\r\n\r\n", at)
    size = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", data[at:cut]) if cut >= 0 else None
    return min(len(data), cut + 4 + int(size[1]) + 4) if size else len(data)


def _member_at(view: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes | None, int, str]:
    """As much of the member at `at` as it takes, fed in steps so that the rest of the file is not copied."""
    opened, parts, upto = zlib.decompressobj(31), [], at
    try:
        while not opened.eof and upto < len(view):
            parts.append(opened.decompress(view[upto:upto + step]))
            upto += step
    except zlib.error as error:
        return None, at, f"gzip: {error}"
    if not opened.eof:
        return None, at, "gzip: member cut short"
    return b"".join(parts), min(upto, len(view)) - len(opened.unused_data), ""


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, refers_to): null refers_to is a response.

    Of payloads that are equal and have at least `least_bytes` bytes, the least page_id is the response. Rows that
    repeat its id and payload are responses too; null ids refer to it like any other, and stand alone without one."""
    rows = pages.select(F.col("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    keys = stored(rows.groupBy("page_id", "sha").agg(F.max("payload_bytes").alias("size")), "payload-digests")
    firsts = keys.filter(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = keys.join(firsts.filter("n > 1"), "sha").filter(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    again = again.filter(F.col("size") >= least_bytes).select(F.col("page_id").alias("k_id"), F.col("sha").alias("k_sha"), "first")
    same = rows["page_id"].eqNullSafe(again["k_id"]) & (rows["sha"] == again["k_sha"])
    return rows.join(again, same, "left").select("page_id", "url", "payload", "payload_bytes", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE, least_bytes: int = 0) -> None:
    """Writes `pages` (page_id, url, html) as gzip archives of at most `records_per_file` records into a new folder."""
    rows = with_roles(pages, least_bytes).select(
        F.col("page_id").cast("string"), F.col("url").cast("string"), "payload", F.col("refers_to").cast("string"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [gzip.compress(record(page, url, payload, other, digest(payload)), 6, mtime=0)
                    for page, url, payload, other in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    packed = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", END_MEMBER.decode("latin-1")).option(
        "maxRecordsPerFile", records_per_file).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record and gap of the archives in `folder`, one row each; gaps have a `problem` and no record fields."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()),
                            ("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()),
                            ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("problem", pa.string())])
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, length, found, problem in salvage(data.as_py()):
                    row = {"path": path, "offset": offset, "length": length, "problem": problem or None}
                    if found is not None:
                        kind = found.get("warc-type")
                        row |= {"record_type": kind, "page_id": found.get("x-page-id") or None, "url": found.get("warc-target-uri"),
                                "payload": found["block"] if kind == "response" else None, "refers_to": found.get("x-refers-to-page"),
                                "payload_digest": digest(found["block"]) if kind == "response" else found.get("warc-payload-digest", "").removeprefix("sha1:"),
                                "payload_bytes": len(found["block"]) if kind == "response" else int(found.get("x-payload-length", 0))}
                        size += len(found["block"])
                    rows.append(row)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(read, RECORD)
