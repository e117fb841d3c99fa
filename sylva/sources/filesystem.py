"""Trees of a file system that driver and executors share."""

from __future__ import annotations

import os
import stat
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.errors import WalkError
from sylva.functions.paths import DIRECTORY, FILE, NANOS, SYMLINK
from sylva.operators.staging import staged
from sylva.operators.tree import _complete

#: Directories that the driver looks for to hand out; it visits so many at most, and holds no rows of them.
FRONTIER = 256
#: Entries of a directory whose metadata is read together.
WINDOW = 1_024
FIELDS = "path string, kind string, size long, mode int, mtime long, mtime_nanos int, target string, link_is_dir boolean, reason string, message string"
Row = tuple
#: The reasons that stop a scan under the policy ``fail``.
ERRORS = ("unreadable", "failed")


@dataclass(frozen=True)
class Listing:
    """The names of a directory, in order; those that aren't UTF-8 count but have no name here."""

    raw: list[bytes]

    def __len__(self) -> int:
        return len(self.raw)

    def __contains__(self, name: str) -> bool:
        want = name.encode("utf-8", "surrogatepass")
        i = bisect_left(self.raw, want)
        return i < len(self.raw) and self.raw[i] == want and _utf8(want) is not None

    def names(self) -> list[str]:
        return [n for r in self.raw if (n := _utf8(r)) is not None]


@dataclass(frozen=True)
class Candidate:
    """What a filter is asked about: before the entry is listed or its metadata read."""

    parent: str
    name: str
    kind: str
    listing: Listing


Keep = Callable[[Candidate], bool]


def _utf8(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def _skip(path: str, reason: str, message: str = "") -> Row:
    return (path, None, None, None, None, None, None, None, reason, message)


def _kind(entry: os.DirEntry) -> str:
    """The kind of an entry as its listing tells it, ``special`` for none of the three, and what went wrong behind ``!``."""
    try:
        return SYMLINK if entry.is_symlink() else DIRECTORY if entry.is_dir(follow_symlinks=False) else FILE if entry.is_file(follow_symlinks=False) else "special"
    except OSError as error:
        return f"!{error.strerror}"


def list_directory(root: bytes, directory: str, full: bool, keep: Keep | None) -> Iterator[Row]:
    """The rows of one directory's entries in order, skips among them (with a reason).

    Reasons: ``special`` and ``non_utf8`` are skipped under any policy; ``unreadable`` (a directory that can't be opened)
    and ``failed`` are errors, with a message. A name or a link's target that isn't UTF-8 is shown lossily.
    Of a directory, names and kinds are held; the rest is read as rows are asked for.
    """
    at = os.path.join(root, directory.encode()) if directory else root
    try:
        scan = os.scandir(at)
    except OSError as error:
        yield _skip(directory, "unreadable", f"listing {directory}: {error.strerror}")
        return
    kinds: dict[bytes, str] = {}
    broken = None
    with scan:
        try:
            for entry in scan:
                kinds[entry.name] = _kind(entry)
        except OSError as error:
            broken = error
    listing = Listing(sorted(kinds))
    for raw_name in listing.raw:
        name, kind = _utf8(raw_name), kinds[raw_name]
        path = f"{directory}/" * bool(directory) + raw_name.decode("utf-8", "replace")
        if name is None:
            yield _skip(path, "non_utf8")
        elif kind[0] == "!":
            yield _skip(path, "failed", f"kind of {path}: {kind[1:]}")
        elif kind == "special":
            yield _skip(path, "special")
        elif keep is None or keep(Candidate(directory, name, kind, listing)):
            yield _read(os.path.join(at, raw_name), path, kind, full)
    if broken is not None:
        yield _skip(directory, "failed", f"listing of {directory}: {broken.strerror}")


def _read(at: bytes, path: str, kind: str, full: bool) -> Row:
    """The row of an entry, with its metadata and target, or a skip."""
    try:
        status = os.lstat(at) if full else None
    except OSError as error:
        return _skip(path, "failed", f"metadata of {path}: {error.strerror}")
    target = None
    if kind == SYMLINK:
        try:
            target = _utf8(raw := os.readlink(at))
        except OSError as error:
            return _skip(path, "failed", f"target of {path}: {error.strerror}")
        if target is None:
            return _skip(path, "non_utf8", raw.decode("utf-8", "replace"))
    return _row(path, kind, status, target)


def _row(path: str, kind: str, status: os.stat_result | None, target: str | None) -> Row:
    size = (status.st_size if status else 0) if kind == FILE else None
    mode = (status.st_mode & 0o7777 if status else 0) if kind != SYMLINK else None
    secs, nanos = divmod(status.st_mtime_ns, NANOS) if status else (None, 0)
    return (path, kind, size, mode, secs, nanos, target, None, None, None)


def walk_below(root: bytes, directory: str, full: bool, keep: Keep | None, deep: bool = True, fail: bool = False) -> Iterator[Row]:
    """The rows of a directory, and with ``deep`` those at all depths below. One directory is open at a time. With ``fail`` an error is the last row."""
    todo = [directory]
    while todo:
        below = []
        for row in list_directory(root, todo.pop(), full, keep):
            yield row
            if fail and row[8] in ERRORS:
                return
            if row[1] == DIRECTORY and deep:
                below.append(row[0])
        todo += reversed(below)


def _frontier(root: bytes, keep: Keep | None, most: int) -> list[tuple[str, bool]]:
    """What tasks start from: the uppermost directories, each listed by itself (False), and those below which all is walked (True).

    The driver visits ``most`` directories at most and one level more, and keeps the paths of directories alone."""
    if not os.path.isdir(root):
        raise WalkError(f"listing {os.fsdecode(root)}: not a directory")
    shallow: list[str] = []
    level = [""]
    while level and len(level) + len(shallow) < most:
        below = []
        for directory in level:
            for row in list_directory(root, directory, False, keep):
                if directory == "" and row[0] == "" and row[8]:
                    raise WalkError(row[9] or "the root can't be read")
                below += [row[0]] if row[1] == DIRECTORY else []
        shallow += level
        level = below
    return [(d, False) for d in shallow] + [(d, True) for d in level]


def scan(spark: SparkSession, root: str, metadata: str = "full", on_error: str = "fail", keep: Keep | None = None, tasks: int = FRONTIER) -> tuple[DataFrame, DataFrame]:
    """The entries below a directory, and what was skipped (path, reason, message).

    The root has no row; a link to it is followed, links below never are. ``keep`` is asked for each
    entry before anything of it is read: below a refused directory nothing is listed. ``metadata``
    is ``full``, or ``kinds`` for names and kinds alone. Errors stop the scan (``fail``: each task stops at its first, and the first in walk
    order is raised) or are counted (``skip``); the row of a directory that can't be opened stays. Root errors are always raised.

    The driver looks for directories to hand out, and asks ``keep`` of what it meets; all rows come from tasks.
    """
    if metadata not in ("full", "kinds") or on_error not in ("fail", "skip"):
        raise ValueError("metadata is full or kinds; on_error is fail or skip")
    full, fail, at = metadata == "full", on_error == "fail", os.fsencode(root)
    found = _frontier(at, keep, tasks)
    starts = spark.createDataFrame(found, "path string, deep boolean")
    rows = spark.createDataFrame([], FIELDS)
    arrow = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Row] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for directory, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in walk_below(at, directory, full, keep, deep, fail):
                    held.append(row)
                    if len(held) >= WINDOW:
                        yield flush()
                        held.clear()
        yield flush()

    out = staged(starts.repartition(min(tasks, len(found))).mapInArrow(run, rows.schema), "scan")
    bad = out.filter(F.col("reason").isin(*ERRORS))
    if fail and (first := bad.agg(F.min_by("message", F.split("path", "/")).alias("m")).first().m) is not None:
        raise WalkError(first)
    return _complete(out.filter("reason is null").drop("reason", "message")), out.filter("reason is not null").select("path", "reason", "message")


def with_file_metadata(entries: DataFrame, root: str) -> DataFrame:
    """Reads size, mode and time of entries that were scanned for kinds; ``missing`` marks those that couldn't be read.

    Directories get time and mode, files all, links their time. Only a root that can't be opened is an error."""
    at = os.fsencode(root)
    os.close(os.open(at, os.O_RDONLY))
    names = entries.columns
    schema = T.StructType([*entries.schema.fields, T.StructField("missing", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            missing = []
            for i, (path, kind) in enumerate(zip(columns["path"], columns["kind"])):
                try:
                    status = os.lstat(os.path.join(at, path.encode()))
                except OSError:
                    status = None
                row = _row(path, kind, status, None)
                for n, v in zip(("size", "mode", "mtime", "mtime_nanos"), row[2:6]):
                    columns[n][i] = v
                missing.append(status is None)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns.values(), missing], arrow)], schema=arrow)

    return entries.mapInArrow(run, schema)


def open_file_metadata(descriptor: int) -> dict:
    """Size, mode and time of an open regular file; WalkError for anything else."""
    status = os.fstat(descriptor)
    if not stat.S_ISREG(status.st_mode):
        raise WalkError("not a regular file")
    return dict(zip(("size", "mode", "mtime", "mtime_nanos"), _row("", FILE, status, None)[2:6]))


@dataclass
class _Below(InputPartition):
    directory: str
    deep: bool


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.full = os.fsencode(options["path"]), options.get("metadata", "full") == "full"
        self.fail, self.tasks = options.get("onerror", options.get("onError", "fail")) == "fail", int(options.get("tasks", FRONTIER))

    def partitions(self):
        return [_Below(*start) for start in _frontier(self.root, None, self.tasks)]

    def read(self, partition: _Below):
        for row in walk_below(self.root, partition.directory, self.full, None, partition.deep):
            if self.fail and row[8] in ERRORS:
                raise WalkError(row[9])
            yield row


class TreeSource(DataSource):
    """``spark.read.format("sylva_tree").option("metadata", "kinds").load(root)``: rows of entries, and of skips with a reason."""

    @classmethod
    def name(cls) -> str:
        return "sylva_tree"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> _TreeReader:
        return _TreeReader(dict(self.options))
