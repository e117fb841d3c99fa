"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The sum of a whole document's log ratios grows with its length, to hundreds, beside which Gumbel noise of
spread 1.3 decides nothing. Weights are tempered, therefore: a document weighs as an excerpt of
``sharpness`` of its n-grams does on average.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sylva.llm.common import Stages, hash_sample

#: Words and single marks.
TOKEN = re.compile(r"\w+|[^\w\s]")
BUCKETS = 1 << 16
#: Labelled rows that target model and threshold are made from, half each; the smallest hashes.
LABELLED_ROWS = 20_000
#: Documents whose n-grams are counted together.
COUNTED = 256
#: N-grams of the excerpt that a document weighs as.
SHARPNESS = 32.0
#: Distinct tokens whose hash a worker keeps.
CACHED = 1 << 17
ODD_1, ODD_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


def features(text: str, hashes: dict[str, int], buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's tokens and of its pairs of neighbouring tokens."""
    tokens = TOKEN.findall(text)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    both = np.concatenate([h * ODD_1, h[:-1] * ODD_2 + h[1:] * ODD_1 + ODD_2])
    return ((both >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, target_ids: frozenset, buckets: int = BUCKETS) -> DataFrame:
    """n-grams of all documents and of the target's by bucket: bucket, raw, target. Each task sums its own first."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("raw", T.LongType()), T.StructField("target", T.LongType())])
    arrow = to_arrow_schema(schema)
    wanted = docs.sparkSession.sparkContext.broadcast(target_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, hashes = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(at, COUNTED)
                each = [features(t.as_py() or "", hashes, buckets) for t in batch.column(1)]
                raw += np.bincount(np.concatenate(each), minlength=buckets)
                for doc_id, found in zip(batch.column(0).to_pylist(), each):
                    if doc_id in wanted.value:
                        target += np.bincount(found, minlength=buckets)
        used = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(raw[used]), pa.array(target[used])], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw for each bucket, with one added to every count. As large as ``buckets``."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.any():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def weighted(docs: DataFrame, ratios: np.ndarray, sharpness: float = SHARPNESS) -> DataFrame:
    """The rows (doc_id, text and more) without ``text``, with ``log_weight``: ``sharpness`` times the mean log ratio of the text's n-grams, 0 without any."""
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("log_weight", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, hashes = sent.value, _Hashes()
        for batch in batches:
            weight = []
            for t in batch.column(len(names)):
                found = features(t.as_py() or "", hashes, len(ratio))
                weight.append(sharpness * float(ratio[found].sum()) / max(1, len(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(weight, pa.float64())], schema=arrow)

    return docs.select(*names, "text").mapInArrow(run, schema)


def gumbel_key(doc_id: Column, log_weight: Column, seed: int = 11) -> Column:
    """log weight plus Gumbel noise that the id and the seed fix: the largest keys are a sample without replacement."""
    bits = 52
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << bits)) + F.lit(0.5)) / F.lit(float(1 << bits))
    return log_weight - F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, unit: float = 1e-6) -> float:
    """A threshold that the k largest of ``key`` reach, in whole ``unit``; counted by bits, not sorted.

    Each round counts the keys of the bucket where the k-th lies in 4,096 finer ones; ``keys`` should be a table that was written."""
    rows = keys.select(F.round(F.greatest(F.least(F.col("key"), F.lit(1e8)), F.lit(-1e8)) / unit).cast("long").alias("q"))
    inside, bucket = F.lit(True), 0
    for shift in (36, 24, 12, 0):
        counts = rows.filter(inside).groupBy(F.shiftright("q", shift).alias("b")).count().orderBy(F.desc("b")).collect()
        for r in counts:
            bucket = r.b
            if k <= r["count"]:
                break
            k -= r["count"]
        inside = F.shiftright("q", shift) == bucket
    return (bucket - 0.5) * unit


def calibrated(weights: list[tuple[float, int]], good_weight: float = 3.0, slack: float = 0.03) -> float:
    """The log weight that separates good (1) from bad (0): -inf without both kinds.

    Thresholds are worth the share of bad documents below and, ``good_weight`` times, of good ones above: to lose a good
    document costs more. Many are worth nearly the same, as few documents lie between; the middle of those within ``slack`` of the best is
    farthest from either kind."""
    good, bad = sorted(x for x, q in weights if q), sorted(x for x, q in weights if not q)
    if not good or not bad:
        return float("-inf")
    values = np.array(sorted({x for x, _ in weights}))
    cuts = np.concatenate([[values[0] - 1], (values[:-1] + values[1:]) / 2])
    kept = 1 - np.searchsorted(good, cuts) / len(good)
    gone = np.searchsorted(bad, cuts) / len(bad)
    worth = good_weight * kept + gone
    best = cuts[worth >= worth.max() * (1 - slack)]
    return float((best[0] + best[-1]) / 2)


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, labelled_rows: int = LABELLED_ROWS, buckets: int = BUCKETS, seed: int = 11, sharpness: float = SHARPNESS, columns: Sequence[str] | None = None, with_keys: bool = True) -> DataFrame:
    """The documents that importance resampling keeps, with all their columns, or ``columns``, and, ``with_keys``, also ``log_weight`` and
    ``key``, which replace columns of those names.

    The raw model counts the hashed n-grams of all documents, the target model those of documents
    labelled good (doc_id, quality 0 or 1), of at most ``labelled_rows`` labelled rows. A document's
    log weight is ``sharpness`` times the mean of log p_target - log p_raw over its n-grams; Gumbel noise fixed by its id is added, and
    the k largest keys stay. Without ``k``, it is the number of documents whose log weight is above the
    threshold that separates good from bad among labelled documents that the target model
    didn't see. Keys that tie with the last all stay, so do rows that repeat a doc_id and a text together.

    Texts are read twice: for the models, and for the keys. Null and empty texts weigh 0. Without good or without bad
    labels nothing is known, and all stay. A document with labels of both kinds is bad; of rows that repeat a labelled doc_id
    the smallest log weight counts for the threshold.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    n_known = known.agg(F.approx_count_distinct("doc_id")).first()[0]
    known = hash_sample(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", labelled_rows, n_known, seed).collect()
    train = frozenset(r.doc_id for r in known[::2] if r.quality == 1)
    held = {r.doc_id: r.quality for r in known[1::2]}
    stages = Stages(docs.sparkSession, "quality")
    ratios = log_ratios(bucket_counts(docs, train, buckets), buckets)
    # The documents' own columns travel in one, so that none clashes.
    names = list(columns or docs.columns)
    rows = docs.select("doc_id", F.struct(*names).alias("_doc"), "text")
    scored = weighted(rows, ratios, sharpness).withColumn("key", gumbel_key(F.col("doc_id"), F.col("log_weight"), seed))
    scored = stages.write(scored, "scored")
    if k is None and train:
        tried = docs.sparkSession.createDataFrame(list(held.items()), "doc_id long, quality int")
        found = scored.join(F.broadcast(tried), "doc_id").groupBy("doc_id", "quality").agg(F.min("log_weight").alias("log_weight")).collect()
        cut = calibrated([(r.log_weight, r.quality) for r in found])
        k = scored.filter(F.col("log_weight") >= cut).count() if cut > float("-inf") else None
    if k is not None:
        scored = scored.filter(F.col("key") >= (kth_largest(scored, k) if k > 0 else float("inf")))
    if not with_keys:
        return scored.select("_doc.*")
    return scored.select(*[F.col("_doc")[c].alias(c) for c in names if c not in ("log_weight", "key")], "log_weight", "key")
