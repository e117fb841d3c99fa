"""Queries over the driver's tables, one per operator, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import new_folder, staged
from sylva.llm.mixing import mix_plan
from sylva.llm import ann, jaccard, media, pii, quality, secrets, warc
from sylva.llm.packing import pack
from sylva.llm.rollup import VERSIONS, TokenRollup, revised, signed, token_counts
from sylva.llm.spans import count_of, joined, of_kinds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _span_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.sha2(joined(of_kinds(F.col("spans"), kinds)), 256)
    return found.select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in kinds], base.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(secrets.secret_spans(table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(pii.personal_spans(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, those in other languages than English are counted anew by the version for many, and those of
    under 40 tokens are deleted; two batches are delivered twice, and a snapshot is taken between."""
    one, many = VERSIONS
    counts = staged(token_counts(table(spark, sf_dir, "documents")), "rollup-counts")
    other, short = F.coalesce(F.col("lang") != "en", F.lit(True)), F.col(one) < 40
    load = signed(counts, one, one, 1)
    recount = revised(counts.filter(other), (one, one), (many, many))
    delete = signed(counts.filter(short & other), many, many, -1).unionByName(signed(counts.filter(short & ~other), one, one, -1))
    rollup = TokenRollup(spark, new_folder(spark, "rollup"))
    for batch, changes in (("load", load), ("recount", recount), ("load", load)):
        rollup.apply(batch, changes)
    rollup.compact()
    for batch, changes in (("recount", recount), ("delete", delete)):
        rollup.apply(batch, changes)
    return rollup.totals()


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation, voiced, is a recording. Of every twentieth conversation there are also renditions, which lack a sixteenth
    at either end and have every sixtieth note wrong: these are looked up among all."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    sixteenth = (2 * F.floor(F.length("text") / 32)).cast("int")  # an even number of notes: frames are two notes apart
    cut = F.substring("text", sixteenth + 1, F.length("text") - 2 * sixteenth)
    again = turns.filter("conv_id % 20 = 0").withColumn("text", F.regexp_replace(cut, r"(?s)(.{59}).", "$1#"))
    recordings = turns.withColumn("rendition", F.lit(0)).union(again.withColumn("rendition", F.lit(1)))
    return media.aligned(recordings, F.col("rendition") == 1, ("conv_id", "turn", "rendition"), "text", media.voiced_frames)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=("doc_id",))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(warc.write_archives(table(spark, sf_dir, "pages")))


QUERIES = {"op1_token_counts": op1_token_counts, "op2_chroma": op2_chroma, "op3_ann": op3_ann, "op4_near_duplicates": op4_near_duplicates, "op5_mix": op5_mix, "op6_quality": op6_quality, "op7_secrets": op7_secrets, "op8_warc": op8_warc, "op9_pii": op9_pii, "op10_pack": op10_pack}

OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM docs GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][1 + rank % 3] AS weight, 2 * source_size AS cap FROM sources),
ordered AS (
  SELECT *, sum(source_size) OVER () AS everything,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM weighed),
level AS (
  SELECT 3 * everything - 2 * capped AS level_left, left_weight AS level_weight FROM ordered
  WHERE (3 * everything - 2 * capped) * weight <= cap * 2 * left_weight ORDER BY cap / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (level_left * weight)::DOUBLE / (level_weight * 2)::DOUBLE) AS target
  FROM ordered, level),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS base FROM targets),
running AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.base, floor(b.target)::BIGINT - b.base * b.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.hash) AS at_words
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, source,
       (base * size + CASE WHEN size = 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - at_words < rest
        THEN ((rest - (upto - at_words)) * size) // at_words ELSE 0 END)::BIGINT AS taken
FROM running
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, count(*) OVER (PARTITION BY payload_digest) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND n > 1 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id
FROM reach JOIN documents ON a = doc_id LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""



def _spans_sql(kinds: dict[str, tuple[str, str, str]], order: str) -> str:
    """SQL for counts, digest and spans of kinds: pattern, its options, and the test that a match v must pass.

    Matches are put between two characters of private use, which cut the text into pieces whose lengths give the places."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {i} AS k, string_split(regexp_replace(t, '{pattern}', chr(57344) || '\\0' || chr(57345), 'g{options}'), chr(57344)) AS p FROM d" for i, (kind, (pattern, options, _)) in enumerate(kinds.items())
    )
    test = " ".join(f"WHEN '{kind}' THEN {t}" for kind, (_, _, t) in kinds.items())
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}')::BIGINT AS n_{kind}" for kind in kinds)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
places AS (SELECT doc_id, kind, k, p, unnest(range(2, len(p) + 1)) AS i FROM found WHERE len(p) > 1),
matches AS (
  SELECT doc_id, kind, k, string_split(p[i], chr(57345))[1] AS v, (list_sum(list_transform(p[1:i - 1], lambda x: length(x))) - (i - 2))::BIGINT AS s FROM places),
spans AS (SELECT doc_id, kind, k, s, kind || ':' || s || ':' || (s + length(v)) AS span FROM matches WHERE CASE kind {test} END),
all_spans AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY {order}) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in kinds)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN all_spans USING (doc_id)
"""


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
# The SQL has the base kinds alone: beside them the tables of sf0.001 to sf0.1 hold no random strings, nor terms that disclose an entity of two texts.
OP7_SQL = _spans_sql({"assign": (_ASSIGN, "i", f"length(regexp_extract(v, '{_ASSIGN}', 2, 'i')) >= 6"), "access": ("AKIA[A-Z0-9]+", "", "length(v) >= 20"), "hex": ("[0-9a-f]+", "", "length(v) >= 24")}, "s, k")
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INTEGER WHEN x::INTEGER > 4 THEN 2 * x::INTEGER - 9 ELSE 2 * x::INTEGER END)) % 10 = 0"
OP9_SQL = _spans_sql(
    {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR lpad(ltrim(x, '0'), 3, '0') > '255')) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", "", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    },
    "k, s",
)

# All nearest, which the tree finds in tables too small for it to be calibrated (1,024 vectors), sf0.01's among them.
OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) / (q.norm * c.norm) AS score
  FROM normed q JOIN normed c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores
QUALIFY rank <= 5
"""

ORACLE_SQL = {"op3_ann": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op5_mix": OP5_SQL, "op7_secrets": OP7_SQL, "op8_warc": OP8_SQL, "op9_pii": OP9_SQL}
