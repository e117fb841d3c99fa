"""Virtual trees: leaves derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions.paths import FILE, SYMLINK, nanos_of, seconds_of
from sylva.operators.tree import FILE_MODE, entries_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str):
    return F.col(c).cast("string")


def _nanos(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")) * 1000


def doc_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(_text("doc_id"), F.lit(".txt")))
    return _table(spark, sf_dir, "documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(FILE_MODE).alias("mode"))


def order_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region/nation/customer/order/line. The lines are reduced to paths before anything is joined."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    lines = lines.agg(F.sum(F.col("l_quantity").cast("long")).alias("size"), F.max("l_shipdate").alias("shipped"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat_ws("/", "r_name", "n_name", _text("c_custkey"), _text("o_orderkey"), _text("l_linenumber"))
    ns = _nanos("shipped")
    return rows.select(path.alias("path"), "size", F.lit(FILE_MODE).alias("mode"), seconds_of(ns).alias("mtime"), nanos_of(ns).alias("mtime_nanos"))


def event_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = _nanos("ts")
    path = F.concat_ws("/", _text("user_id"), "event_type", _text("event_id"))
    return _table(spark, sf_dir, "events").select(path.alias("path"), F.octet_length("props").cast("long").alias("size"), F.lit(FILE_MODE).alias("mode"), seconds_of(ns).alias("mtime"), nanos_of(ns).alias("mtime_nanos"))


def page_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of each address; entries_of drops empty names and adds up what is one path."""
    return _table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").cast("long").alias("size"), F.lit(FILE_MODE).alias("mode"))


def conversation_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", _text("conv_id"), "role", _text("turn"))
    return _table(spark, sf_dir, "conversations").select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(FILE_MODE).alias("mode"))


def label_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and a symlink to each from below its label."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("../.."), "source", "lang", F.concat(_text("doc_id"), F.lit(".txt"))).alias("target"))
    links = _table(spark, sf_dir, "labels").join(docs, "doc_id")
    links = links.select(F.concat_ws("/", F.lit("labels"), F.concat(F.lit("q"), _text("quality")), _text("doc_id")).alias("path"), F.lit(SYMLINK).alias("kind"), "target")
    return doc_leaves(spark, sf_dir).unionByName(links, allowMissingColumns=True).withColumn("kind", F.coalesce("kind", F.lit(FILE)))


LEAVES = {"doc": doc_leaves, "order": order_leaves, "event": event_leaves, "page": page_leaves, "conv": conversation_leaves, "label": label_leaves}


def tree(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of(LEAVES[name](spark, sf_dir))


# The same trees in SQL.
_NONE = "NULL::BIGINT AS mtime, 0 AS mtime_nanos, NULL::VARCHAR AS target"
_TIME = "(epoch_us({0}) - ((epoch_us({0}) % 1000000 + 1000000) % 1000000)) // 1000000 AS mtime, ((epoch_us({0}) % 1000000 + 1000000) % 1000000 * 1000)::INTEGER AS mtime_nanos, NULL::VARCHAR AS target"
_DOCS = f"SELECT concat_ws('/', source, lang, doc_id || '.txt') AS path, 'file' AS kind, strlen(text)::BIGINT AS size, 420 AS mode, {_NONE} FROM documents"
LEAVES_SQL = {
    "doc": _DOCS,
    "order": f"""SELECT concat_ws('/', r_name, n_name, c_custkey, o_orderkey, l_linenumber) AS path, 'file' AS kind, size, 420 AS mode, {_TIME.format("shipped")}
      FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT)::BIGINT AS size, max(l_shipdate) AS shipped FROM lineitem GROUP BY ALL)
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "event": f"SELECT concat_ws('/', user_id, event_type, event_id) AS path, 'file' AS kind, strlen(props)::BIGINT AS size, 420 AS mode, {_TIME.format('ts')} FROM events",
    "page": f"SELECT regexp_replace(url, '^[a-z]+://', '') AS path, 'file' AS kind, strlen(html)::BIGINT AS size, 420 AS mode, {_NONE} FROM pages",
    "conv": f"SELECT concat_ws('/', conv_id, role, turn) AS path, 'file' AS kind, strlen(text)::BIGINT AS size, 420 AS mode, {_NONE} FROM conversations",
    "label": f"""{_DOCS} UNION ALL SELECT concat_ws('/', 'labels', 'q' || quality, doc_id) AS path, 'symlink' AS kind, NULL::BIGINT AS size, NULL::INTEGER AS mode,
      NULL::BIGINT AS mtime, 0 AS mtime_nanos, concat_ws('/', '../..', source, lang, doc_id || '.txt') AS target FROM labels JOIN documents USING (doc_id)""",
}


def tree_sql(name: str) -> str:
    """CTEs up to ``entries``: path, parent, name, depth, kind, size, mode, mtime, mtime_nanos, target, comps, estimate."""
    return f"""
raw AS ({LEAVES_SQL[name]}),
leaves AS (SELECT * REPLACE (array_to_string(list_filter(string_split(path, '/'), lambda c: c <> ''), '/') AS path) FROM raw),
above AS (
  SELECT DISTINCT array_to_string(comps[1:n], '/') AS path
  FROM (SELECT comps, unnest(range(1, len(comps))) AS n FROM (SELECT string_split(path, '/') AS comps FROM leaves WHERE path <> ''))),
rows_ AS (
  SELECT path, min(kind) AS kind, sum(size)::BIGINT AS size, max(mode) AS mode, max(mtime) AS mtime, coalesce(arg_max(mtime_nanos, mtime * 1000000000 + mtime_nanos), 0) AS mtime_nanos, min(target) AS target
  FROM leaves WHERE path <> '' AND path NOT IN (SELECT path FROM above) GROUP BY path
  UNION ALL SELECT path, 'directory', NULL, 493, NULL, 0, NULL FROM above),
entries AS (
  SELECT *, array_to_string(comps[1:len(comps) - 1], '/') AS parent, comps[-1] AS name, len(comps)::INTEGER AS depth,
    (CASE kind WHEN 'file' THEN 140 WHEN 'directory' THEN 45 ELSE 46 END + strlen(comps[-1]) + strlen(coalesce(target, '')))::BIGINT AS estimate
  FROM (SELECT *, string_split(path, '/') AS comps FROM rows_))"""


def parts_sql(name: str, budget: int) -> str:
    """CTEs up to ``parted``: the entries with part_no. Starts with a recursive one."""
    return f"""{tree_sql(name)},
up AS (SELECT array_to_string(comps[1:n], '/') AS path, estimate FROM (SELECT comps, estimate, kind, unnest(range(1, len(comps) + 1)) AS n FROM entries) WHERE n < len(comps) OR kind = 'directory'),
sums AS (SELECT path, sum(estimate)::BIGINT AS total FROM up GROUP BY path),
big AS (SELECT path FROM sums WHERE total > {budget}),
kids AS (
  SELECT e.path, e.parent, coalesce(s.total, e.estimate) AS unit, b.path IS NOT NULL AS is_over, row_number() OVER (PARTITION BY e.parent ORDER BY e.comps) AS rn
  FROM entries e LEFT JOIN sums s ON e.path = s.path LEFT JOIN big b ON e.path = b.path
  WHERE e.parent = '' OR e.parent IN (SELECT path FROM big)),
fold AS (
  SELECT path, parent, rn, is_over, CASE WHEN is_over THEN 1 ELSE 0 END AS run, CASE WHEN is_over THEN 0 ELSE unit END AS used FROM kids WHERE rn = 1
  UNION ALL
  SELECT k.path, k.parent, k.rn, k.is_over,
    CASE WHEN k.is_over THEN f.run + 1 WHEN f.used > 0 AND f.used + k.unit > {budget} THEN f.run + 1 ELSE f.run END,
    CASE WHEN k.is_over THEN 0 WHEN f.used > 0 AND f.used + k.unit > {budget} THEN k.unit ELSE f.used + k.unit END
  FROM fold f JOIN kids k ON k.parent = f.parent AND k.rn = f.rn + 1),
unit_of AS (
  SELECT e.path, min_by(f.parent || '//' || f.run, len(e.comps[1:n])) AS part_key
  FROM (SELECT path, comps, unnest(range(1, len(comps) + 1)) AS n FROM entries) e JOIN fold f ON f.path = array_to_string(e.comps[1:n], '/') AND NOT f.is_over GROUP BY e.path),
bare AS (SELECT path, '//' || path AS part_key FROM big WHERE path NOT IN (SELECT parent FROM entries)),
keys AS (SELECT e.*, coalesce(u.part_key, b.part_key) AS own_key FROM entries e LEFT JOIN unit_of u ON e.path = u.path LEFT JOIN bare b ON e.path = b.path),
carried AS (SELECT *, first_value(own_key IGNORE NULLS) OVER (ORDER BY comps ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS part_key FROM keys),
numbered AS (SELECT part_key, row_number() OVER (ORDER BY min(comps)) - 1 AS part_no FROM carried GROUP BY part_key),
parted AS (SELECT c.*, n.part_no FROM carried c JOIN numbered n ON c.part_key = n.part_key)"""
