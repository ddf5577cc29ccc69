r"""WARC archives of pages, and a normaliser for archives that are one gzip stream.

1. `write_archives` writes a record for each page through Spark's text writer: files of one gzip stream over many records, as
   many crawlers leave them. Of pages with equal payloads of at least `REVISIT_BYTES` bytes that with the smallest page_id is a response,
   the others are revisits that refer to it.
2. `normalise` inflates each file once as a stream, writes every record as a gzip member of its own to a new archive and
   beside it an index of (offset, length, record id). Files are written under another name and moved into place, so a
   task that runs twice leaves the same files.
3. `read_archives` reads single records back by the index.

Archives live in the shared folder; tasks reach it through `pyarrow.fs` (local or mounted folders, HDFS, object stores).

Defined cases: a null html is an empty payload; a null page_id has the id urn:x-page:null and reads back as null, and never is
the smallest; rows of one page_id with equal payloads are all responses; white space in a URL is written as %20, a null
URL as an empty one; an empty table gives no archive and an empty result; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.llm.common import materialise
from revspark.session import shared_path

REVISIT_BYTES = 100
#: Records of one monolithic file: it is read as one row.
FILE_RECORDS = 2000
INFLATE_BYTES = 1 << 20

#: FIXED VALUES of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(record): the text of each page's WARC record, without the two line ends behind it."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"),
                       html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    firsts = (own.where(F.col("n") >= REVISIT_BYTES).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    typed = own.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(VERSION.decode() + "\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri("page_id")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(line("WARC-Refers-To", uri("first")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return typed.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    (records(pages).write.option("compression", "gzip").option("lineSep", "\r\n\r\n")
     .option("maxRecordsPerFile", file_records).text(path))


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file, in pieces; of one stream or of several members."""
    data = memoryview(data)
    at, stream = 0, zlib.decompressobj(31)
    while at < len(data):
        piece = data[at:at + INFLATE_BYTES // 4]
        at += len(piece)
        while len(piece):
            yield stream.decompress(piece, INFLATE_BYTES)
            while stream.unconsumed_tail:
                yield stream.decompress(stream.unconsumed_tail, INFLATE_BYTES)
            piece = memoryview(stream.unused_data)
            if stream.eof:
                stream = zlib.decompressobj(31)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream, each with its two line ends behind it; what is held is one record and one piece."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + content_length(held[:end]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError(f"archive ends inside a record ({len(held)} bytes are left)")


def headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {bytes(lines[0][:40])!r}")
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}


def content_length(head: bytes) -> int:
    return int(headers(bytes(head))["content-length"])


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path; Hadoop also writes file:/path."""
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _put(target: str, data: bytes) -> None:
    where, path = _place(target)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(part) as out:
        out.write(data)
    where.move(part, path)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the archives under `source` to `target`; the index (archive, at, length, record_id) of all of them."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                archive = f"{target}/{name.rpartition('/')[2].partition('.')[0]}.warc.gz"
                out, index = bytearray(), []
                for record in split_records(inflated(data.as_py())):
                    member = gzip.compress(record, mtime=0)
                    index.append((len(out), len(member), headers(record.partition(b"\r\n\r\n")[0])["warc-record-id"]))
                    out += member
                _put(archive, bytes(out))
                _put(archive + ".idx", "".join(json.dumps(dict(zip(("offset", "length", "id"), x, strict=True))) + "\n" for x in index).encode())
                at, length, ids = zip(*index, strict=True) if index else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(index), pa.string()), pa.array(at, pa.int64()),
                                                  pa.array(length, pa.int64()), pa.array(ids, pa.string())],
                                                 names=["archive", "at", "length", "record_id"])

    folder, path = _place(target)
    folder.create_dir(path, recursive=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    return materialise(files.mapInArrow(rewrite, "archive string, at long, length long, record_id string"), "warc-index")


def read_record(member: bytes) -> dict:
    """Page id, type, digest, size, payload (None for a revisit) and referred page of one gzip member."""
    record = gzip.decompress(member)
    head, _, rest = record.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[:int(h["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    stated = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    again = h["warc-type"] == "revisit"
    page = lambda uri: None if uri.endswith(":null>") else int(uri[len(_ID) + 1:-1])
    return {"page_id": page(h["warc-record-id"]), "payload_bytes": stated if again else len(body),
            "payload_digest": h["warc-payload-digest"].partition(":")[2] if again else hashlib.sha256(body).hexdigest(),
            "record_type": h["warc-type"], "refers_to": page(h["warc-refers-to"]) if again else None,
            "url": h["warc-target-uri"], "payload": None if again else body}


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each record of the index, read by its offset; without `payload` only its size and digest return."""
    schema = _ROW if payload else _ROW.remove(_ROW.get_field_index("payload"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = []
                part = batch.slice(start, 500)
                for archive, at, length in zip(*(part.column(c).to_pylist() for c in ("archive", "at", "length")), strict=True):
                    if archive != name:
                        where, path = _place(archive)
                        name, file = archive, where.open_input_file(path)
                    file.seek(at)
                    rows.append(read_record(file.read(length)))
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return index.mapInArrow(read, ddl + ", payload binary" * payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of `pages`, normalise them and read every record back."""
    spark = pages.sparkSession
    source, target = shared_path(spark, "warc"), shared_path(spark, "warc-normal")
    write_archives(pages, source)
    return read_archives(normalise(spark, source, target), payload=False)
