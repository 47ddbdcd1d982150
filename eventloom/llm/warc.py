"""WARC archives with segmented records: writing, reading and segment reassembly.

A response's block is an HTTP message whose body is framed in chunks. Blocks longer than
``SEGMENT_BYTES`` are written as a first segment and ``continuation`` records that name it as
their origin. Reading groups the continuation records by origin, orders them by segment number,
checks that the numbers are gapless and the lengths add up to the total, and takes the chunk
framing off. Of pages with equal payloads the one with the smallest id is a response and the
others are ``revisit`` records that refer to it.

Every record is a gzip member of its own, as the format recommends. Spark's text writer puts a
separator after each row; the separator is a zero byte, which is also the last byte of every
gzip member of less than 16 MiB, so that rows come without their last byte and the files are
exact. Files have a bounded size (``BLOB_BYTES`` x ``BLOBS_PER_FILE``), because a reading task
holds one file.

Defined results: a null html is an empty payload; a null url is written as ``about:blank``;
pages of a null id are revisits where their payload has an id and else responses; rows that
repeat the smallest id are all responses; payloads under ``min_bytes`` are all responses; a
record that is incomplete or damaged gives a null payload and an ``error``; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import run_folder

from .common import staged, table
from .registry import query

SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 12
BLOB_BYTES = 1 << 20
BLOBS_PER_FILE = 16
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of a payload's SHA-1, from 20 bits (five hex digits) at a time."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    digits = [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in groups for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The body without its chunk framing; raises ``ValueError`` if that is damaged."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size < 0 or at + size > len(body):
            raise ValueError("chunk beyond the end")
        if size == 0:
            if not body[at:].endswith(b"\r\n"):
                raise ValueError("no end of trailers")
            return b"".join(parts)
        parts.append(body[at : at + size])
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("not an HTTP message")
    fields = [line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line]
    coding = b",".join(v.lower() for k, v in fields if k.strip().lower() == b"transfer-encoding")
    return unchunked(body) if b"chunked" in coding else body


def _urn(page_id: object, digest: str) -> str:
    raw = hashlib.sha1(f"{page_id}/{digest}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=raw, version=5)}>"


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    named = {"WARC-Type": kind, **fields, "Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _page_records(page_id, url, html, digest, first_id, revisit, segment_bytes) -> Iterator[bytes]:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    target = "about:blank" if url is None else "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)
    name = _urn(page_id, digest)
    common = {"WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{digest}"}
    if revisit:
        own = {"WARC-Record-ID": _urn(f"revisit/{page_id}", digest), "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _urn(first_id, digest)}
        yield _record("revisit", own | common | {"Content-Type": "application/http; msgtype=response"}, head)
        return
    block = head + chunked(html.encode("utf-8", "surrogatepass"))
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = {"WARC-Record-ID": name, "Content-Type": "application/http; msgtype=response"} | common
    yield _record("response", first | ({"WARC-Segment-Number": 1} if len(parts) > 1 else {}), parts[0])
    for number, part in enumerate(parts[1:], 2):
        fields = {
            "WARC-Record-ID": _urn(f"{page_id}/{number}", digest),
            "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": name,
            "WARC-Segment-Number": number,
            "WARC-Segment-Total-Length": len(block) if number == len(parts) else None,
        }
        yield _record("continuation", fields, part)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of all ``pages`` (``page_id, url, html``) below ``path``."""
    if segment_bytes >= 1 << 23:
        raise ValueError("segments must stay below 8 MiB")
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), sha1_base32(payload.cast("binary")).alias("digest"))
    groups = keyed.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = staged(groups.filter("n > 1").select(F.col("digest").alias("same"), "first_id"), "warc-repeated")
    joined = keyed.join(repeated, (F.col("digest") == F.col("same")) & (F.octet_length("html") >= min_bytes), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = joined.select("page_id", "url", "html", "digest", "first_id", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for columns in zip(*batch.columns, strict=True):
                for record in _page_records(*[c.as_py() for c in columns], segment_bytes):
                    held.append(record)
                    size += len(record)
                if size >= BLOB_BYTES:
                    yield pa.RecordBatch.from_pydict({"blob": [b"".join(held)[:-1]]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"blob": [b"".join(held)[:-1]]})

    blobs = rows.mapInArrow(run, "blob binary").select(F.col("blob").cast("string"))
    blobs.write.option("lineSep", "\u0000").option("maxRecordsPerFile", BLOBS_PER_FILE).text(path)


FIELDS = {
    "record_id": "WARC-Record-ID",
    "kind": "WARC-Type",
    "page_id": "WARC-Page-ID",
    "refers_to": "WARC-Refers-To",
    "digest": "WARC-Payload-Digest",
    "origin_id": "WARC-Segment-Origin-ID",
    "segment": "WARC-Segment-Number",
    "total": "WARC-Segment-Total-Length",
}
RECORDS = "record_id string, kind string, page_id string, refers_to string, digest string, origin_id string, segment int, total long, block binary, error string"


def _members(data: bytes) -> Iterator[bytes]:
    """The uncompressed parts of an archive, member by member."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        if not data[at]:  # padding between members
            at += 1
            continue
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof and at < len(data):
            piece = data[at : at + (1 << 14)]
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        if not unpacker.eof:
            raise ValueError("cut gzip member")
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive; a damaged rest is one row with an error."""
    try:
        for part in _members(data):
            at = 0
            while at < len(part):
                end = part.index(b"\r\n\r\n", at)
                head = part[at:end].decode("utf-8").split("\r\n")
                if not head[0].startswith("WARC/"):
                    raise ValueError("no record here")
                fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head[1:])}
                size = int(fields["content-length"])
                block = part[end + 4 : end + 4 + size]
                if len(block) < size:
                    raise ValueError("cut record")
                row = {k: fields.get(name.lower()) for k, name in FIELDS.items()}
                for k in ("segment", "total"):
                    row[k] = int(row[k]) if row[k] else None
                yield row | {"block": block, "error": None}
                at = end + 4 + size + 4
    except (ValueError, KeyError, zlib.error) as problem:
        yield dict.fromkeys(FIELDS) | {"kind": "damaged", "block": None, "error": str(problem)}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; a task holds one bounded archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(k, pa.int32() if k == "segment" else pa.int64() if k == "total" else pa.string()) for k in FIELDS]
            + [("block", pa.binary()), ("error", pa.string())]
        )
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse(content.as_py()):
                    rows.append(row)
                    size += len(row["block"] or b"")
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def reassembled(records: DataFrame) -> DataFrame:
    """Complete blocks: ``record_id, kind, page_id, digest, block, error`` of all first records.

    ``records`` is a stored table. Whole records pass as they are; segments are grouped by
    origin. Repeats of a segment count once; a first segment that comes twice gives two rows.
    """
    keep = ["record_id", "kind", "page_id", "digest", "block", "error"]
    whole = records.filter("segment IS NULL AND kind = 'response'").select(*keep)
    parts = records.filter("segment IS NOT NULL").select(F.coalesce("origin_id", "record_id").alias("origin"), "kind", "page_id", "digest", "segment", "total", "block")
    once = parts.groupBy("origin", "segment").agg(
        F.count("*").alias("copies"), F.max("total").alias("total"), F.max("kind").alias("kind"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("block").alias("block")
    )
    grouped = once.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("copies", "kind", "page_id", "digest")],
    )
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    gapless = F.aggregate("parts", F.lit(0), lambda a, x: F.when(x["segment"] == a + 1, a + 1).otherwise(F.lit(-1))) == F.size("parts")
    problem = (
        F.when(~gapless, F.lit("missing segment"))
        .when(F.col("total").isNull(), F.lit("no last segment"))
        .when(size != F.col("total"), F.lit("length differs from the total"))
    )
    joined = grouped.select(
        F.col("origin").alias("record_id"),
        F.coalesce("kind", F.lit("continuation")).alias("kind"),
        "page_id",
        "digest",
        joined_blocks("parts.block").alias("block"),
        problem.alias("error"),
        F.explode(F.array_repeat(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))).alias("copy"),
    )
    return whole.unionByName(joined.select(*keep))


@F.pandas_udf(T.BinaryType())
def joined_blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for blocks in batches:
        yield blocks.map(b"".join)


@F.pandas_udf(T.StructType().add("payload", "binary").add("problem", "string"))
def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for blocks in batches:
        rows = []
        for block in blocks:
            try:
                rows.append((http_payload(block), None))
            except ValueError as problem:
                rows.append((None, str(problem)))
        yield pd.DataFrame(rows, columns=["payload", "problem"])


def payloads(blocks: DataFrame) -> DataFrame:
    """``record_id, page_id, payload, stated_digest, error``: the decoded payload of every complete block."""
    rows = blocks.select("record_id", "page_id", "digest", "error", decoded("block").alias("found"))
    return rows.select(
        "record_id",
        "page_id",
        F.when(F.col("error").isNull(), F.col("found.payload")).alias("payload"),
        F.regexp_replace("digest", "^sha1:", "").alias("stated_digest"),
        F.coalesce("error", "found.problem").alias("error"),
    )


def captures(records: DataFrame) -> DataFrame:
    """Every page of stored ``records``: responses with their payload's size and digest, and
    revisits with those of the response they refer to."""
    found = payloads(reassembled(records)).select(
        "record_id",
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"),
        F.coalesce("error", F.when(F.col("stated_digest") != sha1_base32(F.col("payload")), F.lit("digest differs"))).alias("error"),
    )
    responses = staged(found, "warc-responses")
    named = staged(
        responses.groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")),
        "warc-named",
    )
    revisits = records.filter("kind = 'revisit'").select("page_id", F.col("refers_to").alias("wanted"))
    again = revisits.join(named, F.col("wanted") == F.col("record_id"), "left")
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "error"
    ).unionByName(
        again.select(
            "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to",
            F.when(F.col("record_id").isNull(), F.lit("response not found")).alias("error"),
        )
    )


@query("op4_warc_segments")
def op4_warc_segments(spark, sf_dir):
    path = run_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    found = captures(staged(read_records(spark, path), "warc-records"))
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "error"
    )
