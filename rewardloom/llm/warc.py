"""WARC archives as chunked record tables.

Writing: equal payloads of at least ``LEAST`` bytes are found by digest; the smallest page_id of them is the response, the others
revisit it. A payload is cut into rows of page and chunk number, which a task streams into its current archive (one gzip
member per record), so that Python holds a chunk and never a record. Every attempt of a task writes files of its own below
the session's shared folder, and only those of the attempts that Spark counts are in the stored list of archives.

Reading: each archive is streamed by one task into chunk rows ``(page_id, chunk, data, n_bytes, digest, last)``; ``n_bytes`` and
``digest`` are those of the payload so far, so the last chunk carries the whole payload's without the record ever being held.
A digest that differs from the record's header is an error. A revisit holds no payload; its header names the payload's size
and digest and the response.

Null html is an empty payload. Rows with the same page_id and payload are a record each, with the same record id. A row
without page_id is a response, or, if its payload is a page's, a revisit of that page. A null url leaves the target out. Other
columns are not read. An empty table makes no archive and an empty result. Archives are written through Arrow's file systems,
which must know the scheme of ``spark.checkpoint.dir``. The html of a row is held once by the JVM, as any table cell is.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.tables import stored
from rewardloom.session import work_dir

LEAST = 100
CHUNK = 1 << 16
#: An archive is closed when it is larger than this.
ARCHIVE_BYTES = 256 << 20
#: Names of the format.
VERSION = "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "page_id long, url string, type string, refers_to long, chunk int, data binary, n_bytes long, digest string, last boolean"


def with_types(pages: DataFrame) -> DataFrame:
    """Every page with its ``payload``, ``n_bytes``, ``digest``, and ``refers_to`` if it revisits another."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.col("n_bytes") >= LEAST).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    revisits = long.join(first.drop("n"), "digest").where("page_id is null or page_id <> refers_to").distinct()
    r = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    return rows.join(r, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def chunked(typed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The record table to write: a row per chunk of a payload, at least one; none of a revisit's payload."""
    kept = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(0)
    last = F.greatest(F.lit(0), F.ceil(kept / chunk) - 1).cast("int")
    rows = typed.withColumn("size", kept).withColumn("n_chunks", last + 1)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.when(F.col("size") > 0, F.expr(f"substring(payload, chunk * {chunk} + 1, {chunk})")).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "refers_to", "n_bytes", "digest", "size", "n_chunks", "chunk", part.alias("data"))


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def header(row: dict) -> bytes:
    lines = [VERSION, f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}", f"WARC-Record-ID: {record_id(row['page_id'])}"]
    if row["url"] is not None:
        # Line ends cannot stand in a header.
        lines.append("WARC-Target-URI: " + " ".join(row["url"].splitlines()))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {row['n_bytes']}"]
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {record_id(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html", f"Content-Length: {row['size']}", "", ""]
    return "\r\n".join(lines).encode()


class Archive:
    """An archive that is being written; a record begins with its header, goes on with chunks and ends."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        files, path = fs.FileSystem.from_uri(self.uri)
        self.out, self.records, self.bytes = files.open_output_stream(path, compression=None), 0, 0

    def begin(self, head: bytes) -> None:
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.records += 1
        self.add(head)

    def add(self, data: bytes) -> None:
        packed = self.member.compress(data)
        self.bytes += len(packed)
        self.out.write(packed)

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        rest = self.member.flush()
        self.bytes += len(rest)
        self.out.write(rest)

    def closed(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pydict({"uri": [self.uri], "records": [self.records]})


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Write the record table to archives below ``folder``; the list of them, ``uri`` and ``records``, is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            data = batch.column("data")
            for i, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
                if row["chunk"] == 0:
                    if archive and archive.bytes > ARCHIVE_BYTES:
                        yield archive.closed()
                        archive = None
                    archive = archive or Archive(folder)
                    archive.begin(header(row))
                archive.add(data[i].as_py())
                if row["chunk"] + 1 == row["n_chunks"]:
                    archive.end()
        if archive:
            yield archive.closed()

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path)
    return stored(chunks.mapInArrow(run, "uri string, records long"), "archives")


class _Stream:
    """The plain bytes of an archive, read by lines and by pieces of bounded size."""

    def __init__(self, uri: str, piece: int = 1 << 15):
        files, path = fs.FileSystem.from_uri(uri)
        # A decompressing stream would stop at the end of the first member.
        self.source, self.piece = files.open_input_stream(path, compression=None), piece
        self.held, self.at, self.member = b"", 0, zlib.decompressobj(31)

    def _more(self) -> bool:
        """Hold what another piece of the file unpacks to behind what is held and not yet taken."""
        raw = self.member.unused_data or self.source.read(self.piece)
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        if not raw:
            return False
        parts = [self.held[self.at :]]
        while raw:
            parts.append(self.member.decompress(raw))
            raw = self.member.unused_data
            if raw:
                self.member = zlib.decompressobj(31)
        self.held, self.at = b"".join(parts), 0
        return True

    def line(self) -> str | None:
        while (end := self.held.find(b"\r\n", self.at)) < 0:
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError("an archive ends inside a line")
                return None
        line, self.at = self.held[self.at : end], end + 2
        return line.decode()

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("an archive ends inside a record")
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            if part:
                yield part


def records(uri: str) -> Iterator[dict]:
    """The chunk rows of an archive, in order."""
    stream = _Stream(uri)
    while (line := stream.line()) is not None:
        if line != VERSION:
            raise ValueError(f"not a record: {line[:80]}")
        fields: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.partition(": ")
            fields[name] = value
        kind, size = fields["WARC-Type"], int(fields["Content-Length"])
        said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        common = {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": kind}
        common["refers_to"] = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
        running, seen, chunk = hashlib.sha256(), 0, 0
        for data in stream.take(size):
            running.update(data)
            seen += len(data)
            if seen == size and running.hexdigest() != said:
                raise ValueError(f"{fields['WARC-Record-ID']} does not have the digest it names")
            yield {**common, "chunk": chunk, "data": data, "n_bytes": seen, "digest": running.hexdigest(), "last": seen == size}
            chunk += 1
        if size == 0:
            yield {**common, "chunk": 0, "data": b"", "n_bytes": int(fields["X-Payload-Length"]), "digest": said, "last": True}
        if stream.line() != "" or stream.line() != "":
            raise ValueError(f"{fields['WARC-Record-ID']} does not end where it says")


def read(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk rows of all archives; without their data, only the last of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows: list[dict] = []
                for row in records(uri):
                    if with_data:
                        rows.append(row)
                    elif row["last"]:
                        rows.append({**row, "data": b""})
                    if len(rows) >= (64 if with_data else 4096):
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # A task for every archive, however few bytes their names have.
    return archives.select("uri").repartition(max(1, archives.count())).mapInArrow(run, CHUNKS)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the session's shared folder; the stored list of them."""
    return write(chunked(with_types(pages)), work_dir(pages.sparkSession, "warc"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    found = read(archived(spark.read.parquet(f"{sf_dir}/pages.parquet")), with_data=False).where("last")
    return found.select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


SQL = f"""
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as n from pages),
d as (select page_id, n, sha256(html) as h from p),
f as (select *, min(page_id) over (partition by h) as first from d)
select page_id, n as payload_bytes, h as payload_digest,
 case when n >= {LEAST} and page_id <> first then 'revisit' else 'response' end as record_type,
 case when n >= {LEAST} and page_id <> first then first end as refers_to
from f"""
