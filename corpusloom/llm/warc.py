"""WARC archives: written with an index, read back by the index alone.

A task writes the records of its partition, each a gzip member of its own, to an archive in the shared folder and yields an
index row (archive, offset, length, url, digest ...) for each. The index is a table written with Spark's commit, so rows of
lost or repeated attempts, and their archives, are in no index. A reader takes the index rows that it wants, deals them out by
archive and offset into tasks of about TASK bytes of archive, coalesces neighbouring byte ranges and fetches each at once.
Archives lie in the shared folder: a mounted one, or one that pyarrow's file systems know by its address (hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop, new_path, save, ship

INDEX = "archive string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Ranges less than GAP bytes apart are fetched at once, up to RANGE bytes a fetch. An archive ends at the first record past ARCHIVE
#: bytes. A task reads about TASK bytes.
GAP, RANGE, ARCHIVE, TASK = 64 << 10, 4 << 20, 256 << 20, 64 << 20
#: Fixed: the date in every record, so that reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"


def open_file(uri: str, mode: str):
    """A file of the shared folder, by Python where it is a mounted folder, else by the file system that its address names."""
    if uri.startswith("file:") or "://" not in uri:
        path = "/" + uri.removeprefix("file:").lstrip("/")
        if mode == "wb":
            import os

            os.makedirs(path.rpartition("/")[0], exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    if mode == "wb":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record; first: the page whose response this one revisits."""
    body = payload if first is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header_text(url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _write(folder: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None:
                        name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = open_file(name, "wb")
                    payload = (html or "").encode()
                    member = gzip.compress(record(page, url, payload, first), 6, mtime=0)
                    out.write(member)
                    rows.append((name, at, len(member), page, url, len(payload), digest(payload), "response" if first is None else "revisit", first))
                    at += len(member)
                    if at > ARCHIVE:
                        out.close()
                        out = None
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return apply


def _fetch(rows: list[tuple]) -> Iterator[tuple[tuple, bytes]]:
    """The records of index rows sorted by archive and offset, by ranges that are fetched at once."""
    i = 0
    while i < len(rows):
        name, start, end, j = rows[i][0], rows[i][1], rows[i][1] + rows[i][2], i + 1
        while j < len(rows) and rows[j][0] == name and rows[j][1] <= end + GAP and rows[j][1] + rows[j][2] - start <= RANGE:
            end, j = max(end, rows[j][1] + rows[j][2]), j + 1
        with open_file(name, "rb") as f:
            f.seek(start)
            block = f.read(end - start)
        for row in rows[i:j]:
            yield row, zlib.decompress(block[row[1] - start : row[1] - start + row[2]], wbits=31)
        i = j


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        got: list[tuple] = []
        size = 0
        for row, raw in _fetch(rows):
            head, payload = parse(raw)
            whole = head["warc-type"] == "response"
            found = head["warc-payload-digest"].partition(":")[2]
            if whole and digest(payload) != found:
                raise ValueError(f"{row[0]} at {row[1]}: the payload does not have its digest")
            page, first = (None if (v := head.get(k, "").removeprefix("<urn:page:").rstrip(">")) in ("", "None") else int(v) for k in ("warc-record-id", "warc-refers-to"))
            got.append((page, head["warc-target-uri"], head["warc-type"], int(head["x-payload-length"]), found, first, payload if whole else None))
            size += len(payload)
            if size > RANGE:
                yield _records(got)
                got, size = [], 0
        if got:
            yield _records(got)


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _records(got: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least: int = 0) -> DataFrame:
    """Writes a record for each row of pages and returns the index (INDEX), a written table.

    Of records with equal payloads of at least `least` bytes the one with the smallest id is the response and the others
    revisit it; smaller payloads are all responses. A null html is an empty payload, a null url an empty one, a null id comes
    after all others and is never revisited (such records are responses where no other id has the payload). Rows that repeat
    an id with the same payload: one stays the response. Other columns are ignored. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    html = F.coalesce(column(pages, html_col).cast("string"), F.lit(""))
    rows = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), html.alias("html"))
    key = F.when(F.octet_length("html") >= least, F.sha2("html", 256))
    many = rows.select("page_id", key.alias("key")).where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    # Few payloads occur again: the revisits are found on ids and keys alone and written, so that where they are few the pages
    # are not shuffled, and where they are many no payload draws all its pages into one task.
    many = save(many.select("key", "first"), "payloads")
    again = rows.select("page_id", key.alias("key")).join(many, "key").where(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)))
    again = save(again.select(F.col("page_id").alias("rid"), F.col("key").alias("rkey"), "first").distinct(), "revisits")
    keyed = rows.withColumn("key", key).join(again, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("key") == F.col("rkey")), "left")
    keyed = keyed.select("page_id", "url", "html", "first")
    index = save(keyed.mapInArrow(_write(new_path(spark, "warc")), INDEX), "index")
    drop(many, again)
    return index


def read_records(index: DataFrame) -> DataFrame:
    """READ: the records of the index rows (any selection of them), fetched by coalesced ranges; a revisit has a null payload.

    Tasks are as many as the bytes asked for need, at least one for each core: rows of an index are small, what they name is not.
    """
    wanted = index.select("archive", "offset", "length")
    total = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    wanted = wanted.repartitionByRange(int(tasks), "archive", "offset").sortWithinPartitions("archive", "offset")
    return wanted.mapInArrow(_read, READ)


__all__ = ["parse", "read_records", "record", "write_archives"]
ship(__name__)
