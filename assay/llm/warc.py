"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Archives are tables of byte segments, each a whole number of gzip members (a
WARC file of its own, or, joined in order, one long file). A table rather than
loose files, since Spark's committer then decides which attempt of a task
counts, on any store. A record whose payload another record holds is a revisit
of it. The reader inflates a segment little by little, takes records by their
Content-Length, and checks digests; it holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import cut, pick

LEAST, SEGMENT, STEP = 1000, 1 << 20, 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean, html binary"


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _line(text: str | None) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response, or a revisit whose block has the HTTP headers only."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def inflated(data: bytes, step: int = STEP) -> Iterator[bytes]:
    """The content of each gzip member, from slices of ``step`` bytes."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), bytearray()
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a gzip member")
            out += z.decompress(view[at : at + step])
            at += min(step, len(view) - at)
        at -= len(z.unused_data)
        yield bytes(out)


def headers(data: bytes) -> tuple[str, dict[str, str], int]:
    """First line, headers by lower-case name (continued lines joined), and where the block begins."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record or message has no end of its headers")
    first, *rest = data[:end].decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    last = ""
    for line in rest:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return first, out, end + 4


def agrees(stated: str | None, data: bytes) -> bool | None:
    """Whether ``algorithm:value`` (hexadecimal or base 32) is the digest of ``data``; None if it can't be told."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return None
    digest = hashlib.new(kind.lower(), data).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes | None, bool]]:
    """Headers, block, payload and whether no stated digest disagrees, for each record of any type.

    The payload is what follows the HTTP headers, the whole block where there
    are none, and None for a revisit. A member must hold one whole record.
    """
    for content in inflated(data):
        version, head, at = headers(content)
        size = int(head["content-length"])
        if not version.startswith("WARC/") or content[at + size :] != b"\r\n\r\n":
            raise ValueError("a record isn't framed by its Content-Length")
        block = content[at : at + size]
        http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        payload = None if head["warc-type"] == "revisit" else block[headers(block)[2] :] if http else block
        good = agrees(head.get("warc-block-digest"), block) is not False
        if payload is not None:
            good = good and agrees(head.get("warc-payload-digest"), payload) is not False
        yield head, block, payload, good


def records(data: bytes) -> Iterator[tuple]:
    """Of a page archive: page, url, payload size and SHA-1, type, page referred to, whether all agrees, payload (None for a revisit)."""
    for head, block, payload, good in read_records(data):
        length = int(headers(block)[1]["content-length"])
        digest = head["warc-payload-digest"].removeprefix("sha1:") if payload is None else hashlib.sha1(payload).hexdigest()
        good = good and (payload is None or len(payload) == length)
        yield _number(head["warc-record-id"]), head.get("warc-target-uri"), length if payload is None else len(payload), digest, head["warc-type"], _number(head.get("warc-refers-to")), good, payload


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, level: int = 6) -> DataFrame:
    """A written table (records, body) of archive segments with a record for each row.

    Among equal payloads of at least ``least`` bytes the one with the largest
    id is the response and the others revisit it; rows that repeat that id are
    responses too. Null html is an empty payload. Null ids have an empty
    record name; they count as the least, and where a group has no other they
    are all responses. No rows give no segments.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    # only payloads that several rows share need a lookup
    shared = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    shared = cut(shared.where("n > 1").select("digest", "kept"), "payloads")
    other = (F.octet_length("html") >= least) & (F.col("kept").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("kept"))
    rows = rows.join(shared, "digest", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("kept")).alias("refers_to"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, count = bytearray(), 0
        for batch in batches:
            for page, url, html, digest, refers_to in zip(*(batch.column(k) for k in range(5)), strict=True):
                body += member(record(page.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers_to.as_py()), level)
                count += 1
                if len(body) >= SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([bytes(body)], pa.binary())], names=["records", "body"])
                    body, count = bytearray(), 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([bytes(body)], pa.binary())], names=["records", "body"])

    return cut(rows.mapInArrow(segments, "records long, body binary"), "archive")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the segments in column ``body``; ``html`` is null for revisits, and throughout without ``payloads``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for batch in batches:
            for body in batch.column("body"):
                found, held = [], 0
                for row in records(body.as_py()):
                    found.append(row if payloads else (*row[:-1], None))
                    held += len(found[-1][-1] or b"") + 256
                    if held >= 4 * SEGMENT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return archives.select("body").mapInArrow(run, _RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(archives, payloads=False).drop("html", "url")
