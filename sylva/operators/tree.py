"""Entries of a tree as rows: making, ordering, filtering and adding them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.paths import DIRECTORY, FILE, SYMLINK, components, estimate, parent_of, prefixes

#: Columns that a leaf may bring besides its path, with their types and what they are otherwise.
LEAF = {"kind": ("string", FILE), "size": ("long", None), "mode": ("int", None), "mtime": ("long", None), "mtime_nanos": ("int", 0), "target": ("string", None), "link_is_dir": ("boolean", None)}
ENTRY = ("path", "parent", "name", "depth", *LEAF, "comps")
DIRECTORY_MODE, FILE_MODE = 0o755, 0o644
SKIP_REASONS = ("special", "non_utf8", "unreadable", "failed")


def _complete(rows: DataFrame) -> DataFrame:
    """All columns of an entry from a path and those given."""
    have = set(rows.columns)
    columns = [F.col("path"), *[F.coalesce(F.col(c) if c in have else F.lit(None), F.lit(v)).cast(t).alias(c) for c, (t, v) in LEAF.items()]]
    rows = rows.select(*columns, components(F.col("path")).alias("comps"))
    return rows.select("path", parent_of(F.col("comps")).alias("parent"), F.element_at("comps", -1).alias("name"), F.size("comps").alias("depth"), *LEAF, "comps")


def entries_of(leaves: DataFrame) -> DataFrame:
    """The entries of the tree that ``leaves`` (path, and columns of ``LEAF``) span: each directory above a leaf gets a row.

    Empty names in a path are dropped. Leaves of one path are one entry: sizes add up, times are the
    latest. A leaf whose path other leaves go through is a directory. A null or empty path is none.
    """
    clean = F.array_join(F.filter(components(F.col("path")), lambda c: c != ""), "/")
    leaves = _complete(leaves.withColumn("path", clean).filter("path <> ''"))
    latest = F.max(F.struct("mtime", "mtime_nanos")).alias("t")
    one = leaves.groupBy("path").agg(F.min("kind").alias("kind"), F.sum("size").alias("size"), F.max("mode").alias("mode"), latest, F.min("target").alias("target"), F.max("link_is_dir").alias("link_is_dir"))
    one = one.select("path", "kind", "size", "mode", F.col("t.mtime").alias("mtime"), F.coalesce("t.mtime_nanos", F.lit(0)).alias("mtime_nanos"), "target", "link_is_dir")
    above = leaves.select(F.explode(prefixes(F.col("comps"), own=False)).alias("path")).distinct()
    above = above.select("path", F.lit(DIRECTORY).alias("kind"), F.lit(DIRECTORY_MODE).alias("mode"))
    return _complete(one.join(above, "path", "left_anti").unionByName(above, allowMissingColumns=True))


def in_walk_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy("comps")


def by_kind(entries: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a tree."""
    return {
        DIRECTORY: entries.filter(F.col("kind") == DIRECTORY).select("path", "parent", "name", "mtime", "mtime_nanos", "mode"),
        FILE: entries.filter(F.col("kind") == FILE).select("path", "parent", "name", "size", "mtime", "mtime_nanos", "mode"),
        SYMLINK: entries.filter(F.col("kind") == SYMLINK).select("path", "parent", "name", "target", "mtime", "mtime_nanos", "link_is_dir"),
    }


def with_estimates(entries: DataFrame) -> DataFrame:
    return entries.withColumn("estimate", estimate(F.col("kind"), F.col("name"), F.col("target")))


def subtree_sums(entries: DataFrame, value: str) -> DataFrame:
    """Per directory, the sum of ``value`` over it and all below: path, total.

    Each row adds to its own and all upper directories; the sum starts in each task, so that
    the uppermost directories bring a row from each."""
    own = F.when(F.col("kind") == DIRECTORY, F.array("path")).otherwise(F.array().cast("array<string>"))
    above = F.concat(prefixes(F.col("comps"), own=False), own)
    return entries.select(F.explode(above).alias("path"), value).groupBy("path").agg(F.sum(value).alias("total"))


def totals(entries: DataFrame) -> DataFrame:
    """One row: directories, files, symlinks, entries, total_bytes."""
    count = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return entries.agg(count(DIRECTORY, "directories"), count(FILE, "files"), count(SYMLINK, "symlinks"), F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))


def kept(entries: DataFrame, keep: Column) -> DataFrame:
    """The entries that the predicate keeps and that lie below no directory which it refuses.

    Refused directories are looked up from below by the distinct directories that hold entries,
    not by every entry."""
    keep = F.coalesce(keep, F.lit(False))
    refused = entries.filter(~keep & (F.col("kind") == DIRECTORY)).select(F.col("path").alias("refused"))
    rows = entries.filter(keep)
    holders = rows.select(F.col("parent").alias("holder")).distinct().filter("holder <> ''")
    above = holders.select("holder", F.explode(prefixes(components(F.col("holder")), own=True)).alias("refused"))
    hidden = above.join(refused, "refused", "left_semi").select("holder").distinct()
    return rows.join(hidden, rows.parent == hidden.holder, "left_anti")


def with_sibling(entries: DataFrame, name: str) -> DataFrame:
    """The entries whose directory also lists ``name``."""
    places = entries.filter(F.col("name") == name).select(F.col("parent").alias("_p")).distinct()
    return entries.join(places, entries.parent == places._p, "left_semi")


def listings(entries: DataFrame) -> DataFrame:
    """Per directory that lists anything: parent, names in order, and their number."""
    return entries.groupBy("parent").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count("*").alias("len"))


def skip_counts(skips: DataFrame) -> DataFrame:
    """One row with the number of skipped entries by reason, and their sum."""
    counts = [F.count_if(F.col("reason") == r).cast("int").alias(r) for r in SKIP_REASONS]
    return skips.agg(*counts, F.count_if(F.col("reason").isin(*SKIP_REASONS)).alias("total"))


def with_metadata(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fills size, mode and time of entries from a table by path; ``missing`` tells of those without.

    Directories get time and mode, files all, symlinks the time alone."""
    m = metadata.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mode").alias("_mode"), F.col("mtime").alias("_mtime"), F.col("mtime_nanos").alias("_nanos"))
    out = entries.join(m, entries.path == m._path, "left").withColumn("missing", F.col("_path").isNull())
    size = F.when(F.col("kind") == FILE, F.coalesce("_size", F.lit(0)))
    mode = F.when(F.col("kind") != SYMLINK, F.coalesce("_mode", F.lit(0)))
    return out.withColumns({"size": size.cast("long"), "mode": mode.cast("int"), "mtime": F.col("_mtime"), "mtime_nanos": F.coalesce("_nanos", F.lit(0)).cast("int")}).select(*ENTRY, "missing")


def without_metadata(entries: DataFrame) -> DataFrame:
    """Kinds alone: sizes and modes 0 where the kind has them, times unknown."""
    return entries.withColumns({"size": F.when(F.col("kind") == FILE, F.lit(0)).cast("long"), "mode": F.when(F.col("kind") != SYMLINK, F.lit(0)).cast("int"), "mtime": F.lit(None).cast("long"), "mtime_nanos": F.lit(0)})
