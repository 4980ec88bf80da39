"""A content-addressed WARC archive.

Payload bytes are stored once per SHA-256 digest, as ``resource`` records of
one set of WARC files; the exact header block of every original record stands
in another set, whose ``response`` and ``revisit`` records name the digest.
Reading parses both sets and joins them by digest, which gives the original
records back. Files are written by Spark's text writer (records are UTF-8) and
read as whole files, so any store that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, written

GAP = "\r\n\r\n"
LEAST_SHARED = 100


def _line(name: str, value: Column) -> Column:
    """A header line; empty when the value is null. Line ends are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), safe), F.lit(""))


def write(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", least: int = LEAST_SHARED,
          records_per_file: int = 20_000) -> None:
    """Archive ``pages`` (page_id, url, html) under ``path``.

    Null html is an empty payload. Of the records with equal payloads of at
    least ``least`` bytes the one with the smallest page_id (null last; of
    repeated rows any one) is a response, the others revisit it; smaller
    payloads are responses all. Equal digests are checked to have equal length
    and a second equal hash before anything refers to them.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    heads = written(rows.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", "digest", "bytes",
                                F.xxhash64("payload").alias("second")), "warc-heads")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")
    firsts = heads.groupBy("digest").agg(
        F.min(rank).alias("first"), F.min("bytes").alias("lo"), F.max("bytes").alias("hi"),
        F.min("second").alias("lo2"), F.max("second").alias("hi2"))
    sure = F.when((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")), F.col("first")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads have digest "), F.col("digest"))))
    firsts = firsts.select("digest", sure.alias("first"))
    joined = heads.join(firsts, "digest")
    revisit = (F.col("bytes") >= least) & (F.col("uid") != F.col("first.uid"))
    record_id = lambda page, uid: F.concat(F.lit("<urn:record:"), F.coalesce(page.cast("string"), F.lit("null")),
                                           F.lit(":"), uid.cast("string"), F.lit(">"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    header = F.concat(
        F.lit("WARC/1.1"), _line("WARC-Type", kind),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("uid"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, record_id(F.col("first.page_id"), F.col("first.uid")))),
        _line("X-Refers-To-Page-ID", F.when(revisit, F.col("first.page_id").cast("string"))),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        _line("Content-Length", F.lit("0")), F.lit(GAP))
    _save(joined.select(header.alias("value")), f"{path}/headers", records_per_file)
    store = rows.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    blob = F.concat(
        F.lit("WARC/1.1"), _line("WARC-Type", F.lit("resource")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("Content-Length", F.octet_length("payload").cast("string")), F.lit(GAP), F.col("payload"))
    _save(store.select(blob.alias("value")), f"{path}/payloads", records_per_file)


def _save(records: DataFrame, path: str, records_per_file: int) -> None:
    (records.write.option("lineSep", GAP).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Plain bytes of a gzip file of one or more members, piece by piece."""
    view, at = memoryview(content), 0
    tool = zlib.decompressobj(31)
    while at < len(view):
        yield tool.decompress(view[at:at + step])
        at += step
        while tool.eof:
            rest = tool.unused_data
            tool = zlib.decompressobj(31)
            if not rest:
                break
            yield tool.decompress(rest)
    yield tool.flush()


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(header block, fields, payload) of each record of a WARC byte stream."""
    buffer, gap = bytearray(), GAP.encode()
    pieces = iter(pieces)

    def have(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        seen = 0
        while (end := buffer.find(gap, max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not have(seen + 1):
                if buffer.strip():
                    raise ValueError("a record header is cut off")
                return
        head = bytes(buffer[:end + len(gap)])
        lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins here: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:] if line)
        whole = len(head) + int(fields["Content-Length"])
        if not have(whole + len(gap)):
            raise ValueError("a record is cut off")
        yield head, fields, bytes(buffer[len(head):whole])
        del buffer[:whole + len(gap)]


RECORDS = pa.schema([("page_id", pa.int64()), ("header", pa.string()), ("digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])
BLOBS = pa.schema([("digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 8 << 20, most_rows: int = 5_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size >= most_bytes or len(held) >= most_rows:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py()


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        whole = lambda v: None if v is None else int(v)
        for content in _files(batches):
            for head, f, _ in parse(inflate(content)):
                yield (whole(f.get("X-Page-ID")), head.decode(), f["WARC-Payload-Digest"].partition(":")[2],
                       f["WARC-Type"], whole(f.get("X-Refers-To-Page-ID")))

    yield from _batches(rows(), RECORDS)


def _read_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for content in _files(batches):
            for _, f, payload in parse(inflate(content)):
                yield (f["WARC-Payload-Digest"].partition(":")[2], payload, len(payload),
                       hashlib.sha256(payload).hexdigest())

    yield from _batches(rows(), BLOBS)


def _sql_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, record_type, refers_to, digest, payload,
    payload_bytes, payload_digest) per archived record; digest is what the
    header names, payload_digest is computed from the stored bytes. An empty
    archive gives no rows."""
    def files(part: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{part}").select("content")

    records = files("headers").mapInArrow(_read_records, _sql_schema(RECORDS))
    blobs = files("payloads").mapInArrow(_read_blobs, _sql_schema(BLOBS))
    return records.join(blobs, "digest")


def original(records: DataFrame) -> DataFrame:
    """(page_id, record): the bytes of every record as first written; a
    revisit has no block of its own."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", F.concat(F.encode("header", "UTF-8"), block, F.lit(GAP.encode())).alias("record"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
