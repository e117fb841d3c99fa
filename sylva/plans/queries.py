"""Queries over virtual trees, one or more per operator, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.frames import FORMATS
from sylva.functions.paths import components, nanos_of, seconds_of
from sylva.operators import documents, parts
from sylva.operators import tree as t
from sylva.operators.cut import with_parts
from sylva.operators.staging import shared_dir, staged
from sylva.plans.trees import parts_sql, tree, tree_sql
from sylva.sources.filesystem import scan
from sylva.sources.manifest import frames, read_manifest, unframed, write_manifest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _parted(name: str, budget: int) -> Query:
    return lambda spark, d: with_parts(tree(name, spark, d), budget)


ENTRY = ("path", "parent", "name", "depth", "kind", "size", "mode", "mtime", "mtime_nanos", "target")

# Entries, order, sums.
for _name in ("doc", "order", "event", "page", "conv", "label"):
    query(f"entries_{_name}", f"WITH {tree_sql(_name)} SELECT {', '.join(ENTRY)}, estimate FROM entries")(
        lambda spark, d, n=_name: t.with_estimates(tree(n, spark, d)).select(*ENTRY, "estimate")
    )
    query(f"totals_{_name}", f"""WITH {tree_sql(_name)} SELECT count(*) FILTER (kind = 'directory') AS directories, count(*) FILTER (kind = 'file') AS files,
      count(*) FILTER (kind = 'symlink') AS symlinks, count(*) AS entries, coalesce(sum(size), 0)::BIGINT AS total_bytes FROM entries""")(
        lambda spark, d, n=_name: t.totals(tree(n, spark, d))
    )
for _name in ("doc", "order", "label", "page"):
    query(f"subtree_estimate_{_name}", f"""WITH {tree_sql(_name)} SELECT array_to_string(comps[1:n], '/') AS path, sum(estimate)::BIGINT AS total
      FROM (SELECT comps, estimate, kind, unnest(range(1, len(comps) + 1)) AS n FROM entries) WHERE n < len(comps) OR kind = 'directory' GROUP BY 1""")(
        lambda spark, d, n=_name: t.subtree_sums(t.with_estimates(tree(n, spark, d)), "estimate")
    )
query("subtree_bytes_doc", f"""WITH {tree_sql("doc")} SELECT array_to_string(comps[1:n], '/') AS path, sum(coalesce(size, 0))::BIGINT AS total
  FROM (SELECT comps, size, kind, unnest(range(1, len(comps) + 1)) AS n FROM entries) WHERE n < len(comps) OR kind = 'directory' GROUP BY 1""")(
    lambda spark, d: t.subtree_sums(tree("doc", spark, d).withColumn("size", F.coalesce("size", F.lit(0))), "size")
)


@query("walk_order", f"WITH {tree_sql('event')} SELECT path, lag(path) OVER (ORDER BY comps) AS before FROM entries")
def walk_order(spark: SparkSession, d: str) -> DataFrame:
    """Each path with the one before it in walk order; a range sort, numbered across its partitions' edges."""
    rows = t.in_walk_order(tree("event", spark, d).select("path", "comps"))
    ranged = staged(rows.withColumn("_part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("_part").orderBy("comps")
    last = ranged.groupBy("_part").agg(F.max_by("path", "comps").alias("last"))
    last = last.withColumn("edge", F.lag("last").over(Window.orderBy("_part"))).select("_part", "edge")  # one row per partition
    out = ranged.withColumn("lagged", F.lag("path").over(inside)).join(last, "_part")
    return out.select("path", F.coalesce("lagged", "edge").alias("before"))


@query("kind_tables", f"""WITH {tree_sql("label")}, x AS (SELECT *, string_split(path, '/') AS c FROM entries)
  SELECT kind, count(*) AS n, arg_min(path, c) AS first_path, arg_max(path, c) AS last_path FROM x GROUP BY kind""")  # fmt: skip
def kind_tables(spark: SparkSession, d: str) -> DataFrame:
    """The three tables of a tree, put together again."""
    tables = t.by_kind(tree("label", spark, d))
    out = None
    for kind, rows in tables.items():
        rows = rows.select(F.lit(kind).alias("kind"), "path", components(F.col("path")).alias("comps"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.min_by("path", "comps").alias("first_path"), F.max_by("path", "comps").alias("last_path"))


@query("first_path", f"WITH {tree_sql('doc')} SELECT arg_min(path, comps) AS first_path FROM entries")
def first_path(spark: SparkSession, d: str) -> DataFrame:
    return tree("doc", spark, d).agg(F.min_by("path", "comps").alias("first_path"))


# Filters.
@query("filter_prune", f"""WITH {tree_sql("doc")}, no AS (SELECT path FROM entries WHERE kind = 'directory' AND (name = 'fr' OR name = 'src3'))
  SELECT path, kind FROM entries e WHERE NOT (name = 'fr' OR name = 'src3') AND name NOT LIKE '%7.txt'
  AND NOT EXISTS (SELECT 1 FROM no WHERE e.path LIKE no.path || '/%')""")  # fmt: skip
def filter_prune(spark: SparkSession, d: str) -> DataFrame:
    return t.kept(tree("doc", spark, d), ~F.col("name").isin("fr", "src3") & ~F.col("name").endswith("7.txt")).select("path", "kind")


@query("listing_contains", f"WITH {tree_sql('event')} SELECT path FROM entries WHERE parent IN (SELECT parent FROM entries WHERE name = 'purchase')")
def listing_contains(spark: SparkSession, d: str) -> DataFrame:
    return t.with_sibling(tree("event", spark, d), "purchase").select("path")


@query("listings", f"WITH {tree_sql('conv')} SELECT parent, string_agg(name, ',' ORDER BY name) AS names, count(*) AS len FROM entries GROUP BY parent")
def listings(spark: SparkSession, d: str) -> DataFrame:
    return t.listings(tree("conv", spark, d)).select("parent", F.array_join("names", ",").alias("names"), "len")


_REASON = "CASE WHEN doc_id % 7 = 0 THEN 'special' WHEN doc_id % 11 = 0 THEN 'non_utf8' WHEN doc_id % 13 = 0 THEN 'unreadable' WHEN doc_id % 17 = 0 THEN 'failed' END"


@query("skips", f"""WITH x AS (SELECT {_REASON} AS reason FROM documents) SELECT count(*) FILTER (reason = 'special')::INTEGER AS special,
  count(*) FILTER (reason = 'non_utf8')::INTEGER AS non_utf8, count(*) FILTER (reason = 'unreadable')::INTEGER AS unreadable, count(*) FILTER (reason = 'failed')::INTEGER AS failed, count(reason) AS total FROM x""")  # fmt: skip
def skips(spark: SparkSession, d: str) -> DataFrame:
    return t.skip_counts(spark.read.parquet(f"{d}/documents.parquet").select(F.expr(_REASON).alias("reason")))


# Behind a name's text: nothing, a byte that starts nothing, a start without its end, an overlong form, half a surrogate pair, a point beyond the last, and a whole character.
_TAILS = ("", "ff", "c3", "c0af", "eda080", "f4908080", "e282ac")
_SHOWN = ("", "\ufffd", "\ufffd", "\ufffd\ufffd", "\ufffd\ufffd\ufffd", "\ufffd\ufffd\ufffd\ufffd", "€")


@query("utf8_validity", f"""SELECT doc_id, doc_id % 7 IN (0, 6) AS valid, 'a' || doc_id || [{", ".join(f"'{x}'" for x in _SHOWN)}][1 + doc_id % 7] || 'z' AS shown FROM documents""")
def utf8_validity(spark: SparkSession, d: str) -> DataFrame:
    """Names as bytes, broken ones among them: whether they are UTF-8, and how they are shown."""
    tail = F.unhex(F.element_at(F.array(*[F.lit(x) for x in _TAILS]), (F.col("doc_id") % 7 + 1).cast("int")))
    raw = F.concat(F.encode(F.concat(F.lit("a"), F.col("doc_id").cast("string")), "UTF-8"), tail, F.encode(F.lit("z"), "UTF-8")).cast("string")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.is_valid_utf8(raw).alias("valid"), F.make_valid_utf8(raw).alias("shown"))


@query("mtime_split", """SELECT event_id, ns, (ns - ((ns % 1000000000 + 1000000000) % 1000000000)) // 1000000000 AS secs, ((ns % 1000000000 + 1000000000) % 1000000000)::INTEGER AS nanos
  FROM (SELECT event_id, (event_id - 5000) * 1234567891 AS ns FROM events)""")  # fmt: skip
def mtime_split(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", ((F.col("event_id") - 5000) * 1234567891).alias("ns"))
    return rows.select("event_id", "ns", seconds_of(F.col("ns")).alias("secs"), nanos_of(F.col("ns")).alias("nanos"))


@query("kinds_backfill", f"""WITH {tree_sql("order")} SELECT path, CASE WHEN kind = 'file' THEN CASE WHEN gone THEN 0 ELSE size END END AS size,
  CASE WHEN kind <> 'symlink' THEN CASE WHEN gone THEN 0 ELSE mode END END AS mode, CASE WHEN NOT gone THEN mtime END AS mtime, CASE WHEN gone THEN 0 ELSE mtime_nanos END AS mtime_nanos, gone AS missing
  FROM (SELECT *, strlen(path) % 5 = 0 AS gone FROM entries)""")  # fmt: skip
def kinds_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Kinds alone, then filled from a table of metadata that lacks some rows."""
    full = staged(tree("order", spark, d), "full")
    found = full.filter(F.octet_length("path") % 5 != 0).select("path", "size", "mode", "mtime", "mtime_nanos")
    return t.with_metadata(t.without_metadata(full), found).select("path", "size", "mode", "mtime", "mtime_nanos", "missing")


# Parts.
for _name, _budget in (("doc", 300), ("doc", 4000), ("doc", 1 << 62), ("event", 4000), ("label", 20000), ("order", 60000), ("page", 1500)):
    _key = f"parts_{_name}_b{'whole' if _budget == 1 << 62 else _budget}"
    query(_key, f"WITH RECURSIVE {parts_sql(_name, _budget)} SELECT path, part_no FROM parted")(lambda spark, d, n=_name, b=_budget: _parted(n, b)(spark, d).select("path", "part_no"))

_INDEX = """SELECT part_no, arg_min(path, comps) AS first, count(*) FILTER (kind = 'directory') AS directories, count(*) FILTER (kind = 'file') AS files,
  count(*) FILTER (kind = 'symlink') AS symlinks FROM parted GROUP BY part_no"""


@query("part_index", f"WITH RECURSIVE {parts_sql('label', 4000)} {_INDEX}")
def part_index(spark: SparkSession, d: str) -> DataFrame:
    return parts.part_index(_parted("label", 4000)(spark, d))


@query("index_totals", f"""WITH RECURSIVE {parts_sql("label", 4000)}, i AS ({_INDEX}) SELECT count(*) AS parts, sum(directories)::BIGINT AS directories, sum(files)::BIGINT AS files,
  sum(symlinks)::BIGINT AS symlinks, sum(directories + files + symlinks)::BIGINT AS entries FROM i""")  # fmt: skip
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    return parts.index_totals(part_index(spark, d))


@query("part_summary", f"WITH RECURSIVE {parts_sql('doc', 4000)} SELECT part_no, count(*) AS rows, coalesce(sum(size), 0)::BIGINT AS total_bytes, sum(estimate)::BIGINT AS estimate FROM parted GROUP BY part_no")
def part_summary(spark: SparkSession, d: str) -> DataFrame:
    return parts.part_summary(_parted("doc", 4000)(spark, d))


_LOOKUP = "src1/en"


@query("index_lookup", f"""WITH RECURSIVE {parts_sql("doc", 4000)} SELECT DISTINCT part_no FROM parted WHERE path = '{_LOOKUP}' OR path LIKE '{_LOOKUP}/%'""")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The parts that hold a directory, by the index; then those that do have such rows."""
    rows = staged(_parted("doc", 4000)(spark, d), "lookup")
    may = parts.parts_holding(parts.part_index(rows), F.lit(_LOOKUP)).select("part_no")
    below = (F.col("path") == _LOOKUP) | F.col("path").startswith(_LOOKUP + "/")
    return rows.join(may, "part_no", "left_semi").filter(below).select("part_no").distinct()


_NODES = """first AS (SELECT part_no, min(comps) AS f FROM parted GROUP BY part_no),
stem AS (SELECT part_no, f[1:len(f) - 1] AS stem FROM first),
dirs AS (SELECT part_no, path, row_number() OVER (PARTITION BY part_no ORDER BY comps) - 1 AS idx FROM parted WHERE kind = 'directory'),
ids AS (SELECT p.*, s.stem, (len(s.stem) + 1 + o.idx)::INTEGER AS node_id,
    (CASE WHEN p.parent = '' THEN 0 WHEN a.idx IS NOT NULL THEN len(s.stem) + 1 + a.idx ELSE len(string_split(p.parent, '/')) END)::INTEGER AS parent_id
  FROM parted p JOIN stem s ON p.part_no = s.part_no LEFT JOIN dirs o ON p.part_no = o.part_no AND p.path = o.path LEFT JOIN dirs a ON p.part_no = a.part_no AND p.parent = a.path)"""


def _numbered(name: str, budget: int) -> Query:
    return lambda spark, d: parts.with_node_ids(staged(_parted(name, budget)(spark, d), "parted"))


@query("node_ids", f"WITH RECURSIVE {parts_sql('label', 4000)}, {_NODES} SELECT part_no, path, node_id, parent_id FROM ids")
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    return _numbered("label", 4000)(spark, d).select("part_no", "path", "node_id", "parent_id")


@query("stems", f"WITH RECURSIVE {parts_sql('doc', 300)}, {_NODES} SELECT part_no, array_to_string(f, '/') AS first, array_to_string(f[1:len(f) - 1], '/') AS stem FROM first")
def stems(spark: SparkSession, d: str) -> DataFrame:
    return parts.stems(_parted("doc", 300)(spark, d)).select("part_no", "first", F.array_join("stem", "/").alias("stem"))


@query("path_rebuild", f"WITH RECURSIVE {parts_sql('page', 1500)} SELECT part_no, kind, path FROM parted")
def path_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return parts.rebuilt_paths(_numbered("page", 1500)(spark, d))


# Documents and files.
_ROWS = ("part_no", "path", "kind", "size", "mode", "mtime", "mtime_nanos", "target")


@query("part_json_rows", f"WITH RECURSIVE {parts_sql('label', 4000)}, {_NODES} SELECT part_no, kind, parent_id, node_id, name, size, mode, mtime, mtime_nanos, target FROM ids")
def part_json_rows(spark: SparkSession, d: str) -> DataFrame:
    made = staged(documents.part_documents(_numbered("label", 4000)(spark, d)), "documents")
    return documents.document_rows(made).select("part_no", "kind", "parent_id", "node_id", "name", "size", "mode", "mtime", "mtime_nanos", "target")


@query("index_json", f"""WITH RECURSIVE {parts_sql("doc", 4000)}, i AS ({_INDEX}) SELECT part_no, first, directories, files, symlinks FROM i""")
def index_json(spark: SparkSession, d: str) -> DataFrame:
    """The index through its document: one row, read back."""
    index = parts.part_index(_parted("doc", 4000)(spark, d))
    schema = "format_version int, parts struct<first: array<string>, directories: array<long>, files: array<long>, symlinks: array<long>>"
    read = documents.index_document(index).select(F.from_json("document", schema).alias("d"))
    rows = read.select(F.posexplode(F.arrays_zip(*[F.col(f"d.parts.{c}").alias(c) for c in documents.INDEX_COLUMNS])))
    return rows.select(F.col("pos").cast("long").alias("part_no"), "col.first", "col.directories", "col.files", "col.symlinks")


def _framed(spark: SparkSession, d: str, format: str) -> DataFrame:
    made = documents.part_documents(_numbered("doc", 4000)(spark, d))
    return staged(frames(made, FORMATS[format]), "frames")


@query("zstd_roundtrip", f"WITH RECURSIVE {parts_sql('doc', 4000)}, {_NODES} SELECT part_no, kind, parent_id, node_id, name, size FROM ids")
def zstd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every part through its compressed frame and back to rows."""
    return documents.document_rows(unframed(_framed(spark, d, "zstd"), FORMATS["zstd"])).select("part_no", "kind", "parent_id", "node_id", "name", "size")


@query("seek_offsets", f"""WITH RECURSIVE {parts_sql("doc", 4000)}, {_NODES}, d AS (
  SELECT part_no, '{{"stem":' || to_json(any_value(stem)) || ',"directories":{{"parent":' || to_json(coalesce(list(parent_id ORDER BY comps) FILTER (kind = 'directory'), [])) || ',"name":' || to_json(coalesce(list(name ORDER BY comps) FILTER (kind = 'directory'), []))
    || ',"mode":' || to_json(coalesce(list(mode ORDER BY comps) FILTER (kind = 'directory'), [])) || ',"mtime":' || to_json(coalesce(list(mtime ORDER BY comps) FILTER (kind = 'directory'), [])) || ',"mtime_nanos":' || to_json(coalesce(list(mtime_nanos ORDER BY comps) FILTER (kind = 'directory'), []))
    || '}},"files":{{"parent":' || to_json(coalesce(list(parent_id ORDER BY comps) FILTER (kind = 'file'), [])) || ',"name":' || to_json(coalesce(list(name ORDER BY comps) FILTER (kind = 'file'), []))
    || ',"size":' || to_json(coalesce(list(size ORDER BY comps) FILTER (kind = 'file'), [])) || ',"mode":' || to_json(coalesce(list(mode ORDER BY comps) FILTER (kind = 'file'), [])) || ',"mtime":' || to_json(coalesce(list(mtime ORDER BY comps) FILTER (kind = 'file'), []))
    || ',"mtime_nanos":' || to_json(coalesce(list(mtime_nanos ORDER BY comps) FILTER (kind = 'file'), [])) || '}},"symlinks":{{"parent":[],"name":[],"target":[],"mtime":[],"mtime_nanos":[],"directory":[]}}}}' AS document
  FROM ids GROUP BY part_no)
  SELECT part_no AS frame_no, (strlen(document) + 1)::BIGINT AS raw_length, coalesce(sum(strlen(document) + 1) OVER (ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw_offset FROM d""")  # fmt: skip
def seek_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and offsets of uncompressed frames, down to the byte of each document."""
    before = Window.orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return _framed(spark, d, "plain").select("frame_no", "raw_length", F.coalesce(F.sum("raw_length").over(before), F.lit(0)).alias("raw_offset"))


def _new_file(spark: SparkSession) -> str:
    """A file in the shared folder, by a URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    return f"{store.makeQualified(path)}/{uuid.uuid4().hex}.manifest"


@query("manifest_file", f"WITH RECURSIVE {parts_sql('label', 20000)} SELECT part_no, path, kind, size, mode, mtime, mtime_nanos, target FROM parted")
def manifest_file(spark: SparkSession, d: str) -> DataFrame:
    """The tree through a file in the shared folder: written in order, read a task per part."""
    path = _new_file(spark)
    write_manifest(_parted("label", 20000)(spark, d), path)
    return read_manifest(spark, path).select("part_no", "path", "kind", "size", "mode", "mtime", "mtime_nanos", "target")


@query("manifest_lookup", f"""WITH RECURSIVE {parts_sql("label", 4000)} SELECT path, kind FROM parted WHERE path LIKE 'labels/q0/%'""")
def manifest_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One directory out of a file: the index prunes the parts that are read."""
    path = _new_file(spark)
    write_manifest(_parted("label", 4000)(spark, d), path, "lz4")
    return read_manifest(spark, path, "lz4").filter(F.col("path").startswith("labels/q0/")).select("path", "kind")


@query("fs_scan", """SELECT regexp_extract(filename, '[^/]+$') AS path, '' AS parent, regexp_extract(filename, '[^/]+$') AS name, 1 AS depth, 'file' AS kind, size, epoch(last_modified)::BIGINT AS mtime
  FROM read_blob('/root/testdata/sf0.01/*')""")  # fmt: skip
def fs_scan(spark: SparkSession, d: str) -> DataFrame:
    """The table's own folder, as the file system has it. The SQL is for the folder of sf0.01."""
    entries, _ = scan(spark, d, metadata="full", on_error="skip")
    return entries.select("path", "parent", "name", "depth", "kind", "size", "mtime")
