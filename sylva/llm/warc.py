"""WARC archives: one gzip member per record, written in parallel and read back sequentially."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.llm.common import Stages, join_each, new_folder, staged

# Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "application/http;msgtype=response"
DATE = "1970-01-01T00:00:00Z"
GZIP = 31  # zlib's window bits for a gzip member

#: Reads of an archive, in bytes.
CHUNK = 1 << 20
#: Payloads that several pages have whose digests are sent to every executor at most, about 40 MB.
BROADCAST_GROUPS = 300_000
HTTP_LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]+)", re.IGNORECASE)


class WarcError(ValueError):
    """An archive that breaks the format, or a digest that doesn't match."""


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2]

    @property
    def payload_length(self) -> int:
        """Of the full payload, which a revisit's block leaves out."""
        found = HTTP_LENGTH.search(self.block.partition(END)[0] + b"\r\n")
        return int(found[1]) if found else len(self.payload)


def urn(page_id: int | None) -> str:
    return f"<urn:sylva:page:{'null' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """The gzip member of a response, or of a revisit whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="replace")))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", urn(refers_to))]
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", CONTENT_TYPE), ("Content-Length", str(len(block)))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    member = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return member.compress(text) + member.compress(block) + member.compress(END) + member.flush()


def decode_record(raw: bytes) -> Record:
    """The record of one decompressed member; framing and digests are checked."""
    head, sep, rest = raw.partition(END)
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/"):
        raise WarcError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise WarcError(f"bad header line {line[:60]!r}")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + len(END) or not rest.endswith(END):
        raise WarcError(f"content length {length!r} doesn't frame a member of {len(rest)} bytes")
    record = Record(headers, rest[: -len(END)])
    for name, data in (("warc-block-digest", record.block), ("warc-payload-digest", None if headers.get("warc-type") == "revisit" else record.payload)):
        if data is not None and (digest := headers.get(name)) is not None:
            if digest != f"sha256:{hashlib.sha256(data).hexdigest()}":
                raise WarcError(f"{name} doesn't match in {headers.get('warc-record-id')}")
    return record


def read_records(chunks: Iterator[bytes]) -> Iterator[Record]:
    """The records of an archive, one gzip member each, decompressed as the chunks come.

    Holds one record and one chunk at a time. A stream that ends within a member is an error.
    """
    member, parts, waiting = zlib.decompressobj(GZIP), [], False
    for chunk in chunks:
        while chunk:
            try:
                parts.append(member.decompress(chunk))
            except zlib.error as error:
                raise WarcError(f"bad gzip member: {error}") from error
            chunk, waiting = member.unused_data, True
            if member.eof:
                yield decode_record(b"".join(parts))
                member, parts, waiting = zlib.decompressobj(GZIP), [], False
    if waiting:
        raise WarcError("the archive ends within a record")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """By a path or a URI that pyarrow opens: file, hdfs, s3, gs."""
    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit: int = 100, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record for each page below ``folder``; returns the archives: path, n_records, n_bytes.

    Pages: page_id, url, html; the payload is the html in UTF-8 (null: empty). Of equal payloads of
    at least ``least_revisit`` bytes that with the smallest page_id is the response and others
    revisit it; rows that repeat that page_id are responses too, and so is every page where no
    page of the group has an id. Each attempt of a task writes archives of its own; those of the
    attempts that count are in the table returned, and others in the folder are to be ignored. ``folder``
    (by default in the cluster's shared one) must be seen by all executors.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, folder or new_folder(spark, "warc"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # Digests that repeat: a row for each, however many copies it has. Payloads travel only if there are too many of these to send.
    groups = rows.filter(F.octet_length("payload") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    stages = Stages(spark, "warc")
    groups = stages.write(groups.filter("n > 1 and first is not null"), "groups")
    if groups.count() <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(groups.drop("n")), "digest", "left")
    else:
        rows = join_each(rows.withColumn("_at", F.monotonically_increasing_id()), groups, "digest", "_at", stages, "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size, nth = None, "", 0, 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out
            out.close()
            final = f"{root}/part-{context.partitionId():06d}-{nth:05d}-{context.taskAttemptId()}.warc.gz"
            store.move(name, final)
            done.append((f"{folder}/{final.rpartition('/')[2]}", n, size))
            out = None

        for batch in batches:
            for page_id, url, data, digest, refers in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    name, n, size, nth = f"{root}/_attempt-{context.taskAttemptId()}", 0, 0, nth + 1
                    out = store.open_output_stream(name, compression=None)
                member = encode_record(page_id.as_py(), url.as_py(), data.as_py(), digest.as_py(), refers.as_py())
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], arrow.field(i).type) for i in range(3)], schema=arrow)

    written = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, schema)
    return staged(written, "warc-archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (column path), each archive read from front to back by one task.

    Columns: record_id, record_type, uri, payload_bytes (of the full payload, also for revisits),
    payload_digest, refers_to and, ``with_payload``, the payload. Broken archives raise WarcError.
    """
    fields = [("record_id", T.StringType()), ("record_type", T.StringType()), ("uri", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields + [("payload", T.BinaryType())] * with_payload])
    arrow = to_arrow_schema(schema)

    def chunks(path: str) -> Iterator[bytes]:
        store, at = _open(path)
        with store.open_input_stream(at, compression=None) as data:
            while chunk := data.read(CHUNK):
                yield chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                for r in read_records(chunks(path)):
                    h = r.headers
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), r.payload_length, h.get("warc-payload-digest"), h.get("warc-refers-to"), *([r.payload] * with_payload)))
                    held += len(r.block) * with_payload
                    if len(rows) >= 4096 or held >= CHUNK * 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    # One row per archive: dealt out evenly, so that archives are read in parallel.
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, schema)


def page_records(archives: DataFrame) -> DataFrame:
    """The records of :func:`write_archives` by page: page_id, payload_bytes, payload_digest (bare hex), record_type, refers_to."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:sylva:page:(-?[0-9]+)>$', 1) as bigint)")
    return read_archives(archives).select(
        page("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )
