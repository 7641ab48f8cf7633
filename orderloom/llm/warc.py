"""WARC archives compressed record by record with a dictionary of their own.

A ``.warc.zst`` file starts with a skippable Zstandard frame that holds a dictionary trained
on the file's records; every record follows as a frame of its own, so a reader that has the
dictionary can start at any of them. Payloads that were archived before are written as
``revisit`` records that name the record with the payload.

Tasks write through Arrow's file systems (local, hdfs://, s3:// and so on) under names of
their own, and only files of tasks that Spark counts as done are listed in the manifest. A
task that runs twice leaves a file nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.session import staging_path

#: Payload bytes of an archive; a writing task holds about as many in memory.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of records that a dictionary is trained on.
TRAINING_BYTES = 4 << 20
LEVEL = 3
MIN_REVISIT_BYTES = 1000

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_ID_PREFIX = "<urn:page:"

MANIFEST = "path string, records bigint, payload_bytes bigint, file_bytes bigint"
RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint"
)


def plan_records(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """What to write for each page: ``page_id, url, payload, payload_digest, refers_to``.

    Payloads are equal if SHA-1 and length are. Of pages with an equal payload of at least
    ``min_revisit_bytes``, the one with the largest id is written whole, the others refer
    to it. Pages that share the largest id are all written whole, and so are the pages of a
    payload that only has null ids. A null html is an empty payload, a null url an empty one.

    Digests are counted without the html, and only those met twice are joined back.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.encode(payload, "UTF-8").alias("payload"),
        F.sha1(payload).alias("payload_digest"),
    )
    size = F.octet_length("payload")
    path = staging_path(pages.sparkSession, "warc-copies")
    (
        rows.where(size >= min_revisit_bytes)
        .groupBy("payload_digest", size.alias("_size"))
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1")
        .drop("_copies")
        .write.parquet(path)
    )
    copies = pages.sparkSession.read.parquet(path)
    joined = rows.withColumn("_size", size).join(copies, ["payload_digest", "_size"], "left")
    return joined.select(
        "page_id", "url", "payload", "payload_digest",
        F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"),
    )


def record_bytes(
    page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP head of its payload and no more."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_ID_PREFIX}{page_id}>",
        f"WARC-Date: {date}",
        # Line breaks and other control characters would end the field.
        f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {_ID_PREFIX}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(fields).encode() + _END + block + _END


_URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on evenly spaced records, or made of them if they are too few."""
    step = max(1, -(-sum(map(len, records)) // TRAINING_BYTES))
    samples = records[::step]
    try:
        # Fixed parameters: no search for the best ones.
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8, level=LEVEL)
    except zstandard.ZstdError:
        content = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_frames(records: list[bytes]) -> Iterator[bytes]:
    """The bytes of an archive: the dictionary in a skippable frame, then a frame per record."""
    dictionary = dictionary_of(records)
    content = dictionary.as_bytes()
    yield struct.pack("<II", SKIPPABLE_MAGIC, len(content)) + content
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    for record in records:
        yield compressor.compress(record)


def _frame_end(data: memoryview, start: int) -> int:
    """Where the Zstandard frame that begins at ``start`` ends, from its block headers."""
    header = bytes(data[start : start + 18])
    at = start + zstandard.frame_header_size(header)
    last = False
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * zstandard.get_frame_parameters(header).has_checksum


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    # A trained dictionary is known by its magic number, any other is raw content.
    dictionary = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view, at = memoryview(archive), 8 + size
    while at < len(archive):
        end = _frame_end(view, at)
        yield reader.decompress(view[at:end])
        at = end


@dataclass(frozen=True)
class Record:
    """A parsed record. ``payload`` is None for a revisit."""

    page_id: int | None
    url: str
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def parse_record(record: bytes) -> Record:
    """A record's fields; ValueError if its payload is not the one that it was written with."""
    head, _, rest = record.partition(_END)
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_END)
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers_to = fields.get("WARC-Refers-To")
    return Record(
        _page_of(fields["WARC-Record-ID"]),
        fields.get("WARC-Target-URI", ""),
        payload if kind == "response" else None,
        size,
        digest,
        kind,
        None if refers_to is None else _page_of(refers_to),
    )


def _page_of(urn: str) -> int | None:
    number = urn[len(_ID_PREFIX) : -1]
    return None if number == "None" else int(number)


def write_archives(
    records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes planned records to archives in ``folder`` and returns the manifest.

    The manifest, one row per archive, is stored beside the archives and names just those
    of tasks that finished. An empty table writes no archive and an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        pending: list[bytes] = []
        payloads = 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            size = 0
            with system.open_output_stream(name, compression=None) as out:
                for frame in archive_frames(pending):
                    out.write(frame)
                    size += len(frame)
            row = [[f"{folder}/{name.rpartition('/')[2]}"], [len(pending)], [payloads], [size]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in row], ["path", "records", "payload_bytes", "file_bytes"]
            )

        for batch in batches:
            for row in zip(*[_values(c) for c in batch.columns]):
                record = record_bytes(*row, date)
                pending.append(record)
                payloads += len(record)
                if payloads >= archive_bytes:
                    yield flush()
                    pending, payloads = [], 0
        if pending:
            yield flush()

    manifest = f"{folder}/manifest"
    rows = records.select("page_id", "url", "payload", "payload_digest", "refers_to")
    rows.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return records.sparkSession.read.parquet(manifest)


def _values(column: pa.Array) -> Iterator:
    """A column's values one at a time, so that no list of large payloads is made."""
    return (value.as_py() for value in column)


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives in a manifest, with their ``payload`` if asked for.

    Archives are read one at a time by the task that has their row. Sizes and digests of
    responses are those of the payload as read, and a damaged one fails the job; those of
    revisits are what their record says of the payload that it refers to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = pa.fs.FileSystem.from_uri(path)
                with system.open_input_stream(name, compression=None) as file:
                    archive = file.read()
                records = [parse_record(r) if payload else _bare(r) for r in records_of(archive)]
                for first in range(0, len(records), 1000):
                    part = records[first : first + 1000]
                    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type",
                             "refers_to", *(["payload"] if payload else [])]
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
                             pa.int64(), *([pa.binary()] if payload else [])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([getattr(r, n) for r in part], k) for n, k in zip(names, kinds)],
                        names,
                    )

    tasks = max(1, manifest.count())
    schema = RECORD + (", payload binary" if payload else "")
    return manifest.select("path").repartition(tasks).mapInArrow(read, schema)


def _bare(record: bytes) -> Record:
    """The parsed record without its payload."""
    parsed = parse_record(record)
    return Record(**{**parsed.__dict__, "payload": None})


def archive_pages(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Writes pages to archives in ``folder`` and returns what the archives hold."""
    return read_archives(write_archives(plan_records(pages, page_id, url, html), folder))
