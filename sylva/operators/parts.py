"""Parts of a tree: stems, node numbers, the index and lookups in it, and paths rebuilt from numbers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.errors import PartFull
from sylva.functions.paths import DIRECTORY, FILE, SYMLINK, components

#: Bytes of text that a part's 32-bit offsets can name, and nodes that an INT column can.
MOST_TEXT, MOST_NODES = 1 << 32, (1 << 31) - 1


def stems(parted: DataFrame) -> DataFrame:
    """Per part: part_no, first (its first path) and stem, the names of the directories above that."""
    first = parted.groupBy("part_no").agg(F.min("comps").alias("first_comps"))
    stem = F.slice("first_comps", F.lit(1), F.size("first_comps") - 1)
    return first.select("part_no", F.array_join("first_comps", "/").alias("first"), stem.alias("stem"))


def with_node_ids(parted: DataFrame) -> DataFrame:
    """Adds ``stem``, ``node_id`` (of directories) and ``parent_id`` to rows with a part_no.

    Within a part 0 is the root, then come the directories of the stem, then its own directories in
    walk order. Numbers mean nothing outside their part. :func:`checked` refuses parts that are too large for them."""
    stem = stems(parted).select("part_no", "stem")
    in_part = Window.partitionBy("part_no").orderBy("comps")
    directories = parted.filter(F.col("kind") == DIRECTORY).select("part_no", "path", (F.row_number().over(in_part) - 1).alias("dir_idx"))
    above = directories.select("part_no", F.col("path").alias("parent"), F.col("dir_idx").alias("parent_idx"))
    rows = parted.join(stem, "part_no").join(directories, ["part_no", "path"], "left").join(above, ["part_no", "parent"], "left")
    at = F.size("stem") + 1
    parent_id = F.when(F.col("parent") == "", F.lit(0)).when(F.col("parent_idx").isNotNull(), at + F.col("parent_idx")).otherwise(F.size(components(F.col("parent"))))
    return rows.select(*parted.columns, "stem", (at + F.col("dir_idx")).cast("int").alias("node_id"), parent_id.cast("int").alias("parent_id"))


def checked(parted: DataFrame, most_text: int = MOST_TEXT, most_nodes: int = MOST_NODES) -> DataFrame:
    """The same rows; PartFull if the text of a part, its stem's names among it, or its nodes are too many for its numbers."""
    text = F.sum(F.octet_length("name") + F.octet_length(F.coalesce("target", F.lit(""))))
    size = parted.groupBy("part_no").agg(text.alias("text"), F.count_if(F.col("kind") == DIRECTORY).alias("directories"))
    stem = stems(parted).select("part_no", F.octet_length(F.array_join("stem", "")).alias("above"), (F.size("stem") + 1).alias("depth"))
    over = size.join(stem, "part_no").filter((F.col("text") + F.col("above") >= most_text) | (F.col("directories") + F.col("depth") > most_nodes))
    if (first := over.orderBy("part_no").first()) is not None:
        raise PartFull(f"part {first.part_no} has {first.text + first.above} bytes of text and {first.directories + first.depth} nodes")
    return parted


def nodes(numbered: DataFrame) -> DataFrame:
    """The directory nodes of parts: part_no, node_id, parent_id (null for the root) and name, the root and the stem's directories among them."""
    own = numbered.filter(F.col("kind") == DIRECTORY).select("part_no", "node_id", "parent_id", "name")
    stem = numbered.groupBy("part_no").agg(F.any_value("stem").alias("stem"))
    above = stem.select("part_no", F.posexplode("stem").alias("parent_id", "name")).select("part_no", (F.col("parent_id") + 1).alias("node_id"), "parent_id", "name")
    root = stem.select("part_no", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit("").alias("name"))
    return root.unionByName(above).unionByName(own)


def invalid_rows(numbered: DataFrame) -> DataFrame:
    """Rows of parts made by hand (part_no, stem, kind, name, node_id, parent_id) that no cut could have made, each with a ``reason``.

    A name is one component; directories are numbered on from the stem without a gap and come after their
    parents; other rows have no number; parents are nodes of the part; siblings have names of their own."""
    per = numbered.groupBy("part_no").agg((F.size(F.any_value("stem")) + 1).alias("_first"), F.count_if(F.col("kind") == DIRECTORY).alias("_n"), F.count_distinct("stem").alias("_stems"))
    rank = F.row_number().over(Window.partitionBy("part_no", "kind").orderBy("node_id")) - 1
    twins = F.count("*").over(Window.partitionBy("part_no", "parent_id", "name"))
    rows = numbered.join(per, "part_no").withColumns({"_rank": rank, "_twins": twins})
    is_dir = F.col("kind") == DIRECTORY
    none = F.lit(None).cast("string")
    reason = (
        F.when(F.coalesce(~F.col("kind").isin(DIRECTORY, FILE, SYMLINK), F.lit(True)), "kind")
        .when(F.coalesce((F.col("name") == "") | F.col("name").contains("/") | F.col("name").isin(".", ".."), F.lit(True)), "name")
        .when(F.col("_stems") != 1, "stem")
        .when(is_dir & (F.col("node_id").isNull() | (F.col("node_id") != F.col("_first") + F.col("_rank"))), "node_id")
        .when(~is_dir & F.col("node_id").isNotNull(), "node_id")
        .when(F.coalesce((F.col("parent_id") < 0) | (F.col("parent_id") >= F.col("_first") + F.col("_n")), F.lit(True)), "parent_id")
        .when(is_dir & (F.col("parent_id") >= F.col("node_id")), "parent_id")
        .when(F.col("_twins") > 1, "twice")
        .otherwise(none)
    )
    return rows.withColumn("reason", reason).filter("reason is not null").select(*numbered.columns, "reason")


def part_index(parted: DataFrame) -> DataFrame:
    """Per part: part_no, first, directories, files, symlinks."""
    count = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return parted.groupBy("part_no").agg(F.array_join(F.min("comps"), "/").alias("first"), count(DIRECTORY, "directories"), count(FILE, "files"), count(SYMLINK, "symlinks"))


def index_totals(index: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return index.agg(F.count("*").alias("parts"), total("directories").alias("directories"), total("files").alias("files"), total("symlinks").alias("symlinks"), total(F.col("directories") + F.col("files") + F.col("symlinks")).alias("entries"))


def part_summary(parted: DataFrame) -> DataFrame:
    """Per part: rows, bytes of its files and the estimated bytes of its document."""
    return parted.groupBy("part_no").agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"), F.sum("estimate").alias("estimate"))


def parts_holding(index: DataFrame, directory: Column) -> DataFrame:
    """The parts of an index that may hold entries at or below a directory.

    Parts follow the walk order: a part reaches from its first path to before the first of the next. A
    directory is one run of the order, so these parts are a range. One row per part is ordered here."""
    comps = components(F.col("first"))
    after = F.lead(comps).over(Window.orderBy("part_no"))
    want = components(directory)
    # The first path behind the run: below the same directory, a last name greater than the directory's.
    starts_in = F.slice(comps, F.lit(1), F.size(want)) <= want
    ends_in = F.col("_after").isNull() | (F.col("_after") > want)
    return index.withColumn("_after", after).filter(starts_in & ends_in).drop("_after")


def rebuilt_paths(numbered: DataFrame) -> DataFrame:
    """part_no, kind and path of rows (part_no, kind, name, stem, parent_id, node_id), by their numbers alone.

    A part's directories come before what they hold, so that one pass over a part rebuilds it; a
    part is bounded by its budget."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        path = {0: ""}
        for i, name in enumerate(rows[0]["stem"], 1):
            path[i] = f"{path[i - 1]}/{name}" if path[i - 1] else name
        for r in sorted((r for r in rows if r["node_id"] is not None), key=lambda r: r["node_id"]):
            above = path[r["parent_id"]]
            path[r["node_id"]] = f"{above}/{r['name']}" if above else r["name"]
        full = [f"{path[r['parent_id']]}/{r['name']}" if path[r["parent_id"]] else r["name"] for r in rows]
        return pa.table({"part_no": table["part_no"], "kind": table["kind"], "path": pa.array(full, pa.string())})

    return numbered.select("part_no", "kind", "name", "stem", "parent_id", "node_id").groupBy("part_no").applyInArrow(run, "part_no long, kind string, path string")


