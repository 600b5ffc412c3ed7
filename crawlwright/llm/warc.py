"""WARC archives: write records and their index, then read selected records through coalesced byte ranges.

Index first: every task writes compressed archives (one gzip member per record) and returns one index row per record (archive,
offset, length, URL, digest ...).  The index is written as Parquet, so only the rows of successful task attempts count; an
attempt that dies leaves an unnamed file and nothing else.  Reading takes any subset of the index, brings the entries of one
stretch of an archive together, sorts them by offset and joins neighbours into one range read.

Of records with equal payloads of at least 100 bytes the one with the smallest page_id is the response; the others are revisit
records without a payload that name it.  Equal payloads are found on digests, in narrow rows with map-side minima.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright.llm.common import blocks_for, scratch_path, slices, stash

REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 30  # a task starts a new archive beyond this
STRETCH_BYTES = 16 << 20  # entries of one stretch are read by one task, in order
GAP_BYTES = 64 << 10  # unread bytes that a range read may include between two records
RANGE_BYTES = 4 << 20  # a range read ends once it is this long
DATE = "2024-01-01T00:00:00Z"  # records carry no clock of the writing machine
SALTS = 32

INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                   ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()),
                   ("length", pa.int64())])
RECORDS = pa.schema([*[f for f in INDEX if f.name not in ("archive", "offset", "length")], ("payload", pa.binary())])
_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_SQL[f.type]}" for f in schema)


def _line(text: str) -> str:
    return " ".join(text.split())


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One WARC 1.1 record; a revisit has an empty block."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(page_id, url, type, refers_to, digest, size, payload or None) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    number = lambda name: int(fields[name]) if name in fields else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError(f"page {fields.get('X-Page-ID')}: the payload does not have the digest of its record")
    return (number("X-Page-ID"), fields.get("WARC-Target-URI"), kind, number("X-Refers-To-Page-ID"), digest,
            number("X-Payload-Length"), block if kind == "response" else None)


def records_of(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to)`` for every row of ``pages``.

    A null html is an empty payload.  Rows that share the smallest page_id of a payload are all responses.  A row without a
    page_id is a revisit if a numbered page has its payload, else a response.  Other columns are not read.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")})
    first = (rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
             .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null"))
    # a payload may be on a third of all pages: its rows are spread over SALTS keys
    first = first.select("payload_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(first, ["payload_digest", "_salt"], "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder`` (a URI that every executor reaches) and return their index, itself on disk."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, at, name = None, 0, ""
        try:
            for batch in slices(batches, 2):
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(name, compression=None)
                    data = gzip.compress(record(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"],
                                                r["payload_bytes"], r["payload"]), 6, mtime=0)
                    out.write(data)
                    rows.append({**{k: r[k] for k in INDEX.names if k in r}, "archive": name.removeprefix(f"{root}/"), "offset": at,
                                 "length": len(data)})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, schema=INDEX)
        finally:
            if out is not None:
                out.close()

    return stash(records.mapInArrow(write, ddl(INDEX)), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of any rows of an index: ``(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload)``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        opened, source = None, None
        try:
            for batch in batches:  # sorted by archive and offset
                for archive, spans in _ranges(batch.to_pylist()):
                    if archive != opened:
                        if source is not None:
                            source.close()
                        opened, source = archive, fs.open_input_file(f"{root}/{archive}")
                    start = spans[0][0]
                    data = source.read_at(spans[-1][0] + spans[-1][1] - start, start)
                    rows = [parse_record(gzip.decompress(data[o - start:o - start + n])) for o, n in spans]
                    yield pa.RecordBatch.from_pylist([dict(zip(RECORDS.names, r)) for r in rows], schema=RECORDS)
        finally:
            if source is not None:
                source.close()

    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    tasks = blocks_for(index, F.col("length"), STRETCH_BYTES)  # by bytes to read: the index itself is tiny
    near = index.select("archive", "offset", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    return near.mapInArrow(read, ddl(RECORDS))


def _ranges(rows: list[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Sorted entries -> (archive, spans that one read covers)."""
    spans, archive = [], None
    for r in rows:
        end = spans[-1][0] + spans[-1][1] if spans else 0
        if spans and (r["archive"] != archive or r["offset"] - end > GAP_BYTES or end - spans[0][0] >= RANGE_BYTES):
            yield archive, spans
            spans = []
        archive = r["archive"]
        spans.append((r["offset"], r["length"]))
    if spans:
        yield archive, spans


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to WARC archives and read every record back; an empty table gives no archive and no rows."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(records_of(pages), folder), folder)


def archive_names(folder: str) -> list[str]:
    fs, root = FileSystem.from_uri(folder)
    return sorted(f.path for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.path.endswith(".warc.gz"))
