"""WARC archives through a chunked record table.

A record's payload travels as rows (record, chunk_no, data, running_digest) of at most ``CHUNK`` bytes, in order within a
partition: slices of the cell where it lies, each with the SHA-256 of the payload so far, so no copy of a whole record is
made. Writers stream chunks into gzip members, one member a record, in archives that each task writes under its own name
and publishes by rename; only archives named in the returned manifest count, so a task that is run again leaves nothing
behind that is read. Readers stream an archive and give chunk rows with the bytes counted and their SHA-256 so far; the
last chunk's are the payload's.

Payloads of at least ``MIN_SHARED`` bytes that occur more than once are stored once; the others become revisit records.
Which record is the response is settled on narrow (page_id, digest) rows. A record is named by its page and payload.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import join_hot
from tidemark.session import fresh_path, materialize, ship_package

CHUNK = 64 * 1024
MIN_SHARED = 100
#: Fixed by the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A time stamp that is the same in every run; the tables have no fetch time.
DATE = "2024-01-01T00:00:00Z"

CHUNK_SCHEMA = "record_id string, page_id long, record_type string, refers_to long, chunk_no int, data binary, payload_bytes long, read_bytes long, running_digest string, header_digest string, is_last boolean"
#: The chunked record table on its way into archives.
_CHUNKS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("running_digest", pa.string())])
_CHUNKS_SQL = "page_id long, url string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, data binary, running_digest string"
#: Bytes of chunk rows handed over at once.
FLUSH = 4_000_000


def payload_table(df: DataFrame, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest): size and SHA-256 of the body in UTF-8; null is empty."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    return df.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(body).cast("long").alias("payload_bytes"), F.unhex(F.sha2(body, 256)).alias("digest"))


def decide_revisits(payloads: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records whose payload an earlier page has. A null page_id is always a response;
    rows that repeat an id are decided each by its own payload."""
    big = payloads.where((F.col("payload_bytes") >= MIN_SHARED) & F.col("page_id").isNotNull())
    groups = big.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("last_id > first_id")
    return join_hot(big.select("page_id", "digest"), groups, ["digest"], "n").where("page_id > first_id").groupBy("page_id", "digest").agg(F.min("first_id").alias("refers_to"))


def _records(df: DataFrame, revisits: DataFrame, id_col: str, body_col: str, url_col: str) -> DataFrame:
    """(page_id, url, refers_to, payload_digest, body) per record."""
    by_digest = "digest" in revisits.columns  # decisions without one hold for every row of a page_id
    r = revisits.select(F.col("page_id").alias("r_id"), "refers_to", *[F.lower(F.hex("digest")).alias("r_digest")] * by_digest)
    same = [F.col("page_id") == F.col("r_id"), *([F.col("payload_digest") == F.col("r_digest")] if by_digest else [])]
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("payload_digest"))
    return rows.join(r, same, "left").select("page_id", "url", "refers_to", "payload_digest", "body")


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_records`` -> the chunked record table, slices of the bodies where they lie."""
    rows, held = [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNKS)], schema=_CHUNKS)

    for batch in batches:
        ids, urls, refers, digests = (batch.column(i).to_pylist() for i in range(4))
        bodies = batch.column(4)
        for k in range(batch.num_rows):
            body = bodies[k].as_buffer()
            size, so_far, no = body.size, hashlib.sha256(), 0
            while True:
                data = b"" if refers[k] is not None else memoryview(body)[no * CHUNK : (no + 1) * CHUNK]
                so_far.update(data)
                rows.append((ids[k], urls[k], refers[k], size, digests[k], no, bytes(data), so_far.hexdigest()))
                held += len(data) + 300
                if held > FLUSH:
                    yield batch_of(rows)
                    rows, held = [], 0
                no += 1
                if refers[k] is not None or no * CHUNK >= size:
                    break
            if refers[k] is None and so_far.hexdigest() != digests[k]:
                raise ValueError(f"the payload of page {ids[k]} changed on its way")
    if rows:
        yield batch_of(rows)


def chunk_records(df: DataFrame, revisits: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url") -> DataFrame:
    """The chunked record table: rows of a record follow each other in one partition; a revisit has one empty chunk.

    ``running_digest`` is the SHA-256 of the payload up to the end of the chunk (of nothing for a revisit).
    """
    ship_package(df.sparkSession)
    return _records(df, revisits, id_col, body_col, url_col).mapInArrow(_chunk, _CHUNKS_SQL)


def _name(page_id, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def record_header(page_id, url: str, refers_to, payload_bytes: int, digest: str) -> bytes:
    """Header block of one record. A record's name is made from its page's id and its payload's digest, so runs agree and
    only rows that repeat both share one."""
    kind = "response" if refers_to is None else "revisit"
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id, digest)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {payload_bytes}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}"]
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {payload_bytes if refers_to is None else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _write(folder: str):
    """The chunked record table -> one archive in ``folder`` and its line of the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.warc.gz"
        out, squeeze, records = None, None, 0
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for k in range(batch.num_rows):
                chunk_no = cols[5][k].as_py()
                if out is None:
                    out = store.open_output_stream(name + ".part", compression=None)
                if chunk_no == 0:
                    if squeeze is not None:
                        out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    records += 1
                    out.write(squeeze.compress(record_header(*(cols[i][k].as_py() for i in range(5)))))
                out.write(squeeze.compress(cols[6][k].as_buffer()))
        if out is not None:
            out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
            out.close()
            store.move(name + ".part", name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": [records]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return write


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per partition into ``folder`` (any path pyarrow opens); returns the manifest (path, records)."""
    ship_package(chunks.sparkSession)
    return chunks.mapInArrow(_write(folder), "path string, records long")


def write_records(df: DataFrame, revisits: DataFrame, folder: str, id_col: str = "page_id", body_col: str = "html", url_col: str = "url") -> DataFrame:
    """``write_archives`` of ``chunk_records`` in one pass: chunks go from slicer to writer within the task."""
    ship_package(df.sparkSession)
    write = _write(folder)
    return _records(df, revisits, id_col, body_col, url_col).mapInArrow(lambda batches: write(_chunk(batches)), "path string, records long")


class _Stream:
    """Bytes of a gzip file of many members, by piece; never more than a few chunks in memory. A member without its end is
    an error."""

    def __init__(self, raw):
        self.raw, self.buf, self.z, self.rest, self.done = raw, bytearray(), zlib.decompressobj(31), b"", False
        self.open = False

    def fill(self, least: int) -> None:
        while len(self.buf) < least and not self.done:
            piece = self.rest or self.raw.read(CHUNK)
            if not piece:
                if self.open:
                    raise ValueError("the archive ends within a record")
                self.done = True
                break
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            self.buf += self.z.decompress(piece, 4 * CHUNK)
            self.open = not self.z.eof
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def header(self) -> list[str] | None:
        while (at := self.buf.find(b"\r\n\r\n")) < 0:
            before = len(self.buf)
            self.fill(before + 1)
            if len(self.buf) == before:
                if before:
                    raise ValueError(f"{before} bytes after the last record")
                return None
        return self.take(at + 4)[:-4].decode().split("\r\n")


def read_archive(raw, with_data: bool = True) -> Iterator[tuple]:
    """Chunk tuples in the order of ``CHUNK_SCHEMA`` from an open archive."""
    s = _Stream(raw)
    page = re.compile(r"<urn:page:(-?\d+):[0-9a-f]+>")
    while (lines := s.header()) is not None:
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record: {lines[0]!r}")
        h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        left, digest, no, count = int(h["Content-Length"]), hashlib.sha256(), 0, 0
        name, kind = h["WARC-Record-ID"], h["WARC-Type"]
        ident = int(m[1]) if (m := page.fullmatch(name)) else None
        refers = int(page.fullmatch(h["WARC-Refers-To"])[1]) if "WARC-Refers-To" in h else None
        said = h["WARC-Payload-Digest"].removeprefix("sha256:")
        while True:
            data = s.take(min(left, CHUNK))
            left -= len(data)
            if left and not data:
                raise ValueError(f"{name} is cut short")
            digest.update(data)
            count += len(data)
            yield name, ident, kind, refers, no, data if with_data else None, int(h["X-Payload-Length"]), count, digest.hexdigest(), said, left == 0
            no += 1
            if not left:
                break
        if s.take(4) != b"\r\n\r\n":
            raise ValueError(f"{name} does not end as a record does")


def read_archives(spark: SparkSession, manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The archives of a manifest as a chunked record table (``CHUNK_SCHEMA``), one archive a task.

    An archive that is cut, or holds another number of records than its line of the manifest says, is an error."""
    ship_package(spark)
    names = CHUNK_SCHEMA.replace(",", "").split()[::2]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in zip(names, CHUNK_SCHEMA.replace(",", "").split()[1::2])])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = 0
                store, where = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(where, compression=None) as raw:
                    for row in read_archive(raw, with_data):
                        rows.append(row)
                        found += row[-1]
                        held += len(row[5] or b"") + 300
                        if held > 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if found != records:
                    raise ValueError(f"{path} holds {found} records of {records}")
                if rows:
                    yield batch_of(rows)

    paths = manifest.select("path", "records").repartition(max(1, 2 * spark.sparkContext.defaultParallelism))
    return paths.mapInArrow(read, CHUNK_SCHEMA)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record per row of (page_id, url, html) and reads the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, digest_ok.

    Size and digest of a response are counted from what was read; a revisit has no payload, so its header's are given.
    ``digest_ok``: what was read agrees with the header. Null html and null url are empty. Empty input writes no archive
    and gives no rows. Rows that repeat a page_id are each a record, decided each by its own payload; rows that repeat
    both are responses together or revisits together. Null page_ids are responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    revisits = materialize(decide_revisits(materialize(payload_table(pages), "payloads")), "revisits")
    manifest = materialize(write_records(pages, revisits, fresh_path(spark, "warc")), "manifest")
    last = read_archives(spark, manifest, with_data=False).where("is_last")
    read = F.col("record_type") == "response"
    return last.select(
        "page_id",
        F.when(read, F.col("read_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(read, F.col("running_digest")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        F.when(read, (F.col("running_digest") == F.col("header_digest")) & (F.col("read_bytes") == F.col("payload_bytes"))).otherwise(F.col("read_bytes") == 0).alias("digest_ok"),
    )
