"""Manifest files: a frame for each part and one for the index, read back part by part."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from sylva.errors import ReadError, WriteError
from sylva.frames import FORMATS, MOST_RAW, Format, Span, decoded_line
from sylva.operators.documents import entries_of_document, index_document, parsed_index, part_documents
from sylva.operators.parts import checked, part_index, with_node_ids
from sylva.operators.staging import staged

SCHEMA = "part_no long, path string, parent string, name string, kind string, size long, mode int, mtime long, mtime_nanos int, target string, link_is_dir boolean"


@dataclass(frozen=True)
class Written:
    """What was written: the decoded index, bytes of text, bytes of the file."""

    index: dict
    raw_length: int
    file_length: int


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI that pyarrow opens (file, hdfs, s3, gs), and the place in it; relative paths are local."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def frames(documents: DataFrame, format: Format) -> DataFrame:
    """Each document (part_no, document) as a frame: frame_no, data, raw_length. Encoded where the documents are."""
    codec = format.codec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() + b"\n" for t in batch.column(1).to_pylist()]
            if any(len(r) > MOST_RAW for r in raw):
                raise WriteError("a part's document is too large to be read back")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(r) for r in raw], pa.binary()), pa.array([len(r) for r in raw], pa.int64())], names=["frame_no", "data", "raw_length"])

    return documents.select("part_no", "document").mapInArrow(run, "frame_no long, data binary, raw_length long")


def unframed(made: DataFrame, format: Format) -> DataFrame:
    """The documents of frames: part_no, document. Frames are checked where they are decoded."""
    codec = format.codec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [decoded_line(codec, f.as_py()) for f in batch.column(1)]
            if [len(line) + 1 for line in lines] != batch.column(2).to_pylist():
                raise ReadError("a frame holds more or less text than was recorded")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in lines], pa.string())], names=["part_no", "document"])

    return made.select("frame_no", "data", "raw_length").mapInArrow(run, "part_no long, document string")


def write_manifest(parted: DataFrame, path: str, format: Format | str = "zstd", skips: DataFrame | None = None) -> Written:
    """Writes the parts of a tree (rows with part_no) to one file, in order, and the index after them.

    Frames are made on the executors; the driver appends one after the other and holds one partition of them. The
    bytes depend on the rows alone. The file appears under its name when it is whole.
    """
    format = FORMATS[format] if isinstance(format, str) else format
    rows = staged(parted, "manifest-rows")
    format.codec.encode(b"")  # a codec that refuses its settings does so here
    made = staged(frames(part_documents(with_node_ids(checked(rows))), format), "manifest-frames")
    index = frames(index_document(part_index(rows), skips).select(F.lit(0).cast("long").alias("part_no"), "document"), format).first()
    store, place = store_of(path)
    at, sizes, length = f"{place}.{uuid.uuid4().hex}", [], 0
    try:
        with store.open_output_stream(at, compression=None) as out:
            out.write(format.header())
            for frame in made.orderBy("frame_no").toLocalIterator():
                out.write(bytes(frame.data))
                sizes.append((len(frame.data), frame.raw_length))
            out.write(bytes(index.data))
            sizes.append((len(index.data), index.raw_length))
            out.write(format.trailer(sizes))
            length = out.tell()
        store.move(at, place)
    except OSError as error:
        raise WriteError(f"can't write {path}") from error
    finally:
        try:
            left = store.get_file_info(at).type != fs.FileType.NotFound
        except OSError:
            left = False
        if left:
            store.delete_file(at)
    return Written(parsed_index(decoded_line(format.codec, bytes(index.data))), sum(r for _, r in sizes), length)


def write_lines(parted: DataFrame, folder: str) -> None:
    """The parts' documents as JSON lines, in order, without an index."""
    part_documents(with_node_ids(staged(parted, "lines-rows"))).orderBy("part_no").select("document").write.text(folder)


class ManifestFile:
    """A manifest file: its index, and its parts one at a time."""

    def __init__(self, path: str, format: Format | str = "zstd"):
        self.path, self.format = path, FORMATS[format] if isinstance(format, str) else format
        store, place = store_of(path)
        with store.open_input_file(place) as file:
            length = file.size()
            self.spans: list[Span] = self.format.locate(file, length)
        if not self.spans or any(s.offset + s.length > length for s in self.spans):
            raise ReadError("the file holds no index")
        self.index = parsed_index(self._line(len(self.spans) - 1))
        if len(self.index["parts"]) != len(self.spans) - 1:
            raise ReadError(f"the index tells of {len(self.index['parts'])} parts; the file has {len(self.spans) - 1}")

    def frame(self, n: int) -> bytes:
        """The bytes of frame n; the last is the index."""
        span = self.spans[n]
        store, place = store_of(self.path)
        with store.open_input_file(place) as file:
            return file.read_at(span.length, span.offset)

    def _line(self, n: int) -> bytes:
        line = decoded_line(self.format.codec, self.frame(n))
        if self.spans[n].raw_length not in (None, len(line) + 1):
            raise ReadError(f"frame {n} holds {len(line) + 1} bytes of text; the file tells of {self.spans[n].raw_length}")
        return line

    def part_json(self, n: int) -> bytes:
        if not 0 <= n < len(self.spans) - 1:
            raise ReadError(f"there is no part {n}")
        return self._line(n)

    def parts_holding(self, directory: str) -> list[int]:
        """The parts that may hold entries at or below a directory, by the index alone."""
        key = lambda p: p.encode().split(b"/")
        want, firsts = key(directory), [key(p["first"]) for p in self.index["parts"]]
        return [i for i, f in enumerate(firsts) if f[: len(want)] <= want and (i + 1 == len(firsts) or firsts[i + 1] > want)]


@dataclass
class _Part(InputPartition):
    number: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, format: str):
        self.path, self.format, self.file = path, format, ManifestFile(path, format)
        self.parts = list(range(len(self.file.spans) - 1))

    def pushFilters(self, filters: list[Filter]):
        """Parts that can't hold the rows aren't read; Spark still tests the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("part_no",):
                numbers = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.parts = [p for p in self.parts if p in numbers]
            elif isinstance(f, EqualTo) and f.attribute in (("path",), ("parent",)) and f.value:
                self.parts = [p for p in self.file.parts_holding(f.value) if p in self.parts]
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and f.value.rstrip("/") and f.value.endswith("/"):
                self.parts = [p for p in self.file.parts_holding(f.value.rstrip("/")) if p in self.parts]
            yield f

    def partitions(self):
        return [_Part(n) for n in self.parts]

    def read(self, partition: _Part):
        for r in entries_of_document(self.file.part_json(partition.number)):
            yield (partition.number, r["path"], r["parent"], r["name"], r["kind"], r.get("size"), r.get("mode"), r["mtime"], r["mtime_nanos"], r.get("target"), r.get("directory"))


class ManifestSource(DataSource):
    """``spark.read.format("sylva_manifest").option("format", "zstd").load(path)``: the entries of a manifest file, a task for each part."""

    @classmethod
    def name(cls) -> str:
        return "sylva_manifest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("format", "zstd"))


def read_manifest(spark: SparkSession, path: str, format: str = "zstd") -> DataFrame:
    """The entries of a manifest file, which all executors must see. Filters on part_no, path and parent prune parts."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ManifestSource)
    return spark.read.format("sylva_manifest").option("format", format).load(path)
