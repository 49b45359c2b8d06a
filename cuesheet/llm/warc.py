"""WARC archives compressed record by record with a Zstandard dictionary.

``write_warc`` turns a table of pages into ``.warc.zst`` style archives and
``read_warc`` turns archives back into rows.

An archive is a sequence of Zstandard frames: a skippable frame (magic
``0x184D2A5D``) that holds a dictionary trained on the archive's own records,
then one frame per WARC record, compressed with that dictionary, so any record
can be read on its own after the first frame.

Archives are written by Spark's text writer, one row per file, so they go
through the cluster's file system and commit protocol like any other output.
The writer ends each row with a line separator; here that is the eight bytes
of an empty skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # skippable frame 0x184D2A50 of length 0
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
REVISIT_MIN_BYTES = 100
REVISIT_PROFILE = "http://netpreservefile.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "target_uri string, payload binary"
)


def plan_records(pages: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to`` per page.

    ``refers_to`` is the smallest page_id with an equal payload of at least
    ``min_bytes`` bytes, where that is another page.  The first of each payload
    comes from an aggregation with map-side combine, and the join back is
    skew-splittable on the pages' side, so a payload shared by a third of the
    pages is no single task.  A null page_id counts as the largest.
    """
    p = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    p = p.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn(
        "payload_digest", F.sha2("payload", 256)
    )
    firsts = (
        p.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("payload_digest", "first_id")
    )
    other: Column = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        p.join(firsts, "payload_digest", "left")
        .withColumn("refers_to", F.when(other, F.col("first_id")))
        # a revisit record carries no payload
        .withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
        .drop("first_id")
    )


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_of(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def _header_text(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def warc_record(
    page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_header_text(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES, level: int = 3) -> bytes:
    """Dictionary frame, then one frame per record.

    The dictionary is trained on all records of the archive.  Too few or too
    short records give the trainer nothing to work with; the leading frame is
    then empty and the records are compressed without a dictionary.
    """
    try:
        # fixed d and k: one training pass, no parameter search
        trained = zstandard.train_dictionary(dictionary_bytes, records, d=8, k=50, accel=1)
        raw, packer = trained.as_bytes(), zstandard.ZstdCompressor(level=level, dict_data=trained)
    except zstandard.ZstdError:
        raw, packer = b"", zstandard.ZstdCompressor(level=level)
    lead = DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    return lead + b"".join(packer.compress(r) for r in records)


def _frames(data: bytes) -> Iterator[tuple[bool, bytes]]:
    """(is_dictionary, content) of the frames of an archive, found from their headers."""
    view, at = memoryview(data), 0
    while at < len(data):
        magic = int.from_bytes(view[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC:
                yield True, bytes(view[at + 8 : end])
            at = end
            continue
        lead = bytes(view[at : at + 18])
        end = at + zstandard.frame_header_size(lead)
        last = False
        while not last:
            head = int.from_bytes(view[end : end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            end += 3 + (1 if kind == 1 else size)  # a run-length block holds one byte
        end += 4 * zstandard.get_frame_parameters(lead).has_checksum
        yield False, bytes(view[at:end])
        at = end


def archive_records(data: bytes) -> Iterator[bytes]:
    """The decompressed records of one archive."""
    unpack = zstandard.ZstdDecompressor()
    for is_dictionary, content in _frames(data):
        if is_dictionary:
            known = {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}
            unpack = zstandard.ZstdDecompressor(**known)
        else:
            yield unpack.decompress(content)


def parse_record(record: bytes) -> dict:
    """Fields of READ_SCHEMA; raises if a payload doesn't match its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size, payload = int(fields["WARC-Payload-Length"]), None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload in record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page_of(refers) if refers else None,
        "target_uri": fields.get("WARC-Target-URI"),
        "payload": payload,
    }


def write_warc(
    pages: DataFrame,
    path: str,
    archive_bytes: int = ARCHIVE_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES,
    min_revisit_bytes: int = REVISIT_MIN_BYTES,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html) under ``path``.

    A task holds one open archive, which it closes at ``archive_bytes`` of
    uncompressed records (a longer record is an archive of its own), so memory
    is bounded by that size and the largest page.

    Defined cases: a null html is an empty payload; a null url leaves the
    target header out; rows that share both page_id and payload are one capture
    and each is written as a response; an empty table gives no records; other
    columns of the table are ignored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            done = pa.array([build_archive(held, dictionary_bytes, level)], pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([done], ["archive"])

        for batch in batches:
            for row in batch.to_pylist():
                record = warc_record(
                    row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"],
                    row["refers_to"], date,
                )
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield close()
                    size = 0
        if held:
            yield close()

    archives = plan_records(pages, min_revisit_bytes).mapInArrow(pack, "archive binary")
    (
        archives.select(F.col("archive").cast("string").alias("value"))  # the bytes as they are
        .write.mode("overwrite")
        .option("lineSep", EMPTY_FRAME)
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of READ_SCHEMA for every record of the archives under ``path``.

    Payloads of response records are checked against their digests; a revisit
    has a null payload and names its response in ``refers_to``.
    """
    fields = [f for f in READ_SCHEMA.split(", ") if with_payload or not f.startswith("payload binary")]
    names = [f.split()[0] for f in fields]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, types[f.split()[1]]) for n, f in zip(names, fields, strict=True)])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in archive_records(content.as_py() or b""):
                    rows.append({k: v for k, v in parse_record(record).items() if k in names})
                    size += len(record) if with_payload else 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(unpack, ", ".join(fields))
