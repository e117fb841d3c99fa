"""Documents of parts and of the index: columnar JSON, and back to rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.errors import JsonError
from sylva.functions.paths import DIRECTORY, FILE, SYMLINK

FORMAT_VERSION = 1
# The columns of a part's tables, in the order of the document.
TABLES = {
    "directories": (DIRECTORY, ("parent", "name", "mode", "mtime", "mtime_nanos")),
    "files": (FILE, ("parent", "name", "size", "mode", "mtime", "mtime_nanos")),
    "symlinks": (SYMLINK, ("parent", "name", "target", "mtime", "mtime_nanos", "directory")),
}
INDEX_COLUMNS = ("first", "directories", "files", "symlinks")
SKIP_COLUMNS = ("special", "non_utf8", "unreadable", "failed")
U32 = 1 << 32

PART_SCHEMA = """stem array<string>,
directories struct<parent: array<int>, name: array<string>, mode: array<int>, mtime: array<long>, mtime_nanos: array<int>>,
files struct<parent: array<int>, name: array<string>, size: array<long>, mode: array<int>, mtime: array<long>, mtime_nanos: array<int>>,
symlinks struct<parent: array<int>, name: array<string>, target: array<string>, mtime: array<long>, mtime_nanos: array<int>, directory: array<boolean>>"""


def _column(rows: Column | str, field: str) -> Column:
    """The array of one field of an array of structs."""
    return F.transform(rows, lambda r: r[field]).alias(field)


def _lower_hex(text: Column) -> Column:
    """Escapes of control characters in lower case, as most writers have them."""
    hexes = text
    for upper in "ABCDEF":
        hexes = F.regexp_replace(hexes, r"(?<!\\)((?:\\\\)*\\u00[01])" + upper, "$1" + upper.lower())
    return hexes


def part_documents(numbered: DataFrame) -> DataFrame:
    """Per part: part_no and ``document``, its JSON. ``numbered`` has parent_id and stem.

    A part's rows come together, which its budget bounds."""
    row = F.struct("comps", F.col("parent_id").alias("parent"), "name", "size", "mode", "mtime", F.coalesce("mtime_nanos", F.lit(0)).alias("mtime_nanos"), "target", F.col("link_is_dir").alias("directory"))
    kinds = [F.array_sort(F.collect_list(F.when(F.col("kind") == kind, row))).alias(table) for table, (kind, _) in TABLES.items()]
    grouped = numbered.groupBy("part_no").agg(F.any_value("stem").alias("stem"), *kinds)

    def columns(table: str) -> Column:
        return F.struct(*[_column(table, c) for c in TABLES[table][1]]).alias(table)

    document = F.to_json(F.struct("stem", *[columns(t) for t in TABLES]), {"ignoreNullFields": "false"})
    return grouped.select("part_no", _lower_hex(document).alias("document"))


def index_document(index: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    """One row: ``document``, the JSON of the index (part_no and ``INDEX_COLUMNS``) and of skip counts (one row)."""
    parts = index.agg(F.array_sort(F.collect_list(F.struct("part_no", *INDEX_COLUMNS))).alias("p"))
    columns = F.struct(*[_column("p", c) for c in INDEX_COLUMNS]).alias("parts")
    if skips is None:
        skips = index.sparkSession.range(1).select(*[F.lit(0).alias(c) for c in SKIP_COLUMNS])
    both = parts.crossJoin(skips.select(*SKIP_COLUMNS))  # one row each
    return both.select(_lower_hex(F.to_json(F.struct(F.lit(FORMAT_VERSION).alias("format_version"), columns, F.struct(*SKIP_COLUMNS).alias("skips")))).alias("document"))


def parsed_index(data: bytes | str) -> dict:
    """The index of a document: {"parts": [{first, directories, files, symlinks}], "skips": {...}}; JsonError if it breaks the format."""
    try:
        document = json.loads(data)
    except ValueError as error:
        raise JsonError("the index isn't JSON") from error
    if not isinstance(document, dict) or document.get("format_version") != FORMAT_VERSION or isinstance(document["format_version"], bool):
        raise JsonError("the index has another format version")
    parts, skips = document.get("parts"), document.get("skips")
    if not isinstance(parts, dict) or not isinstance(skips, dict):
        raise JsonError("the index has no parts or no skips")
    for c in INDEX_COLUMNS:
        column = parts.get(c)
        if not isinstance(column, list):
            raise JsonError(f"the index has no column {c}")
        whole = (lambda v: isinstance(v, str)) if c == "first" else (lambda v: type(v) is int and 0 <= v < 1 << 64)
        if not all(map(whole, column)):
            raise JsonError(f"the index has a bad value in {c}")
    if len({len(parts[c]) for c in INDEX_COLUMNS}) != 1:
        raise JsonError("the columns of the index differ in length")
    for c in SKIP_COLUMNS:
        if type(skips.get(c)) is not int or not 0 <= skips[c] < U32:
            raise JsonError(f"the index has a bad count {c}")
    return {"parts": [dict(zip(INDEX_COLUMNS, row)) for row in zip(*(parts[c] for c in INDEX_COLUMNS))], "skips": {c: skips[c] for c in SKIP_COLUMNS}}


def document_rows(documents: DataFrame) -> DataFrame:
    """The rows of parts' documents, still with node numbers: part_no, stem, kind, parent_id, node_id, name and the rest."""
    parsed = documents.select("part_no", F.from_json("document", PART_SCHEMA, {"mode": "FAILFAST"}).alias("d"))
    out = None
    for table, (kind, columns) in TABLES.items():
        zipped = F.arrays_zip(*[F.col(f"d.{table}.{c}").alias(c) for c in columns])
        rows = parsed.select("part_no", F.col("d.stem").alias("stem"), F.posexplode(zipped))
        have = {c: F.col(f"col.{c}") for c in columns}
        none = lambda t: F.lit(None).cast(t)
        node = (F.size("stem") + 1 + F.col("pos")).cast("int") if kind == DIRECTORY else none("int")
        rows = rows.select(
            "part_no", "stem", F.lit(kind).alias("kind"), have["parent"].alias("parent_id"), node.alias("node_id"), have["name"].alias("name"), have.get("size", none("long")).alias("size"),
            have.get("mode", none("int")).alias("mode"), have["mtime"].alias("mtime"), have["mtime_nanos"].alias("mtime_nanos"), have.get("target", none("string")).alias("target"), have.get("directory", none("boolean")).alias("link_is_dir"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def entries_of_document(data: bytes | str) -> Iterator[dict]:
    """The entries of one part's document in walk order, with their paths."""
    try:
        document = json.loads(data)
        paths = {0: ""}
        for i, name in enumerate(document["stem"], 1):
            paths[i] = f"{paths[i - 1]}/{name}" if i > 1 else name
        first, rows = len(document["stem"]) + 1, []
        for table, (kind, columns) in TABLES.items():
            lengths = {len(document[table][c]) for c in columns}
            if len(lengths) != 1:
                raise JsonError(f"the columns of {table} differ in length")
            for i, values in enumerate(zip(*(document[table][c] for c in columns))):
                row = dict(zip(columns, values))
                parent = paths[row.pop("parent")]
                path = f"{parent}/{row['name']}" if parent else row["name"]
                if kind == DIRECTORY:
                    paths[first + i] = path
                rows.append({"path": path, "parent": parent, "kind": kind} | row)
    except (ValueError, KeyError, TypeError) as error:
        raise JsonError("a part's document breaks the format") from error
    yield from sorted(rows, key=lambda r: r["path"].encode().split(b"/"))
