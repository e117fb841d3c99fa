from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylva.llm.quality import calibrated, kth_largest, resampled

#: Large enough for the threshold to be found on labels.
TABLES = "/root/testdata/sf0.1"

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    r = random.Random(3)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7))) for _ in range(80)]
    rows = []
    for i in range(n):
        good = i % 5 != 0
        text = " ".join(r.choice(words) + ("" if good else r.choice(["###", "$$$", "!!!"])) for _ in range(60))
        rows.append((i, text, "en", "s"))
    return rows


def test_held_out_labels(spark):
    """Of the labels neither model nor threshold sees every third."""
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    apart = F.col("doc_id") % 3 == 0
    kept = {r.doc_id for r in resampled(docs, labels.filter(~apart), columns=("doc_id",)).collect()}
    known = [(r.doc_id, r.quality) for r in labels.filter(apart).collect()]
    good, bad = [d for d, q in known if q == 1], [d for d, q in known if q == 0]
    assert sum(d in kept for d in good) >= 0.99 * len(good) and sum(d in kept for d in bad) <= 0.15 * len(bad)


def plain_buckets(text, buckets):
    """The bucket of each token and of each pair of neighbours, in whole numbers."""
    one, two, wrap = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    h = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]", text or "")]
    values = [x * one & wrap for x in h] + [(x * two + y * one + two) & wrap for x, y in zip(h, h[1:])]
    return [(v >> 24) % buckets for v in values]


@pytest.mark.parametrize("k", (None, 60))
def test_weights_keys_and_choice_against_plain_code(spark, documents, k):
    rows = [*corpus(240), (900, None, "en", "s"), (901, "", "en", "s"), (902, "one", "en", "s")]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 240, 2)]
    table = spark.createDataFrame(labels, LABELS)
    order = [r.doc_id for r in table.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").collect()]
    quality_of = {d: q for d, q, _ in labels}
    train, held = {d for d in order[::2] if quality_of[d]}, set(order[1::2])
    raw, target, n = Counter(), Counter(), 1 << 10
    for d, text, *_ in rows:
        raw.update(plain_buckets(text, n))
        if d in train:
            target.update(plain_buckets(text, n))
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))
    weight = {}
    for d, text, *_ in rows:
        found = plain_buckets(text, n)
        weight[d] = 20 * sum(map(ratio, found)) / max(1, len(found))
    bits = {r.id: r.h % (1 << 52) for r in spark.createDataFrame([(d,) for d, *_ in rows], "id long").select("id", F.xxhash64("id", F.lit(11)).alias("h")).collect()}
    key = {d: w - math.log(-math.log((bits[d] + 0.5) / (1 << 52))) for d, w in weight.items()}
    many = k or sum(w >= calibrated([(weight[d], quality_of[d]) for d in held]) for w in weight.values())
    got = {r.doc_id: r for r in resampled(documents(rows, extra=True), table, k=k, buckets=n, sharpness=20.0).collect()}
    assert set(got) == set(sorted(key, key=key.get)[-many:])
    assert all(math.isclose(got[d].log_weight, weight[d], abs_tol=1e-9) and math.isclose(got[d].key, key[d], abs_tol=1e-9) for d in got)
    # The noise decides: it isn't the heaviest documents that stay.
    assert k is None or set(got) != set(sorted(weight, key=weight.get)[-many:])


def test_junk_goes_and_columns_stay(spark, documents):
    docs = documents(corpus(), extra=True)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 3)], LABELS)
    out = resampled(docs, labels, with_keys=False)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert sum(i % 5 == 0 for i in kept) <= 8 and sum(i % 5 != 0 for i in kept) >= 300
    assert {r.doc_id for r in resampled(docs, labels).collect()} == kept  # and again the same


def test_top_k(spark, documents):
    docs = documents(corpus())
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 3)], LABELS)
    for k in (0, 1, 37, 400, 999):
        assert resampled(docs, labels, k=k).count() == min(k, 400)
    few = {r.doc_id for r in resampled(docs, labels, k=50).collect()}
    assert few < {r.doc_id for r in resampled(docs, labels, k=100).collect()}


def test_kth_largest(spark):
    r = random.Random(1)
    values = [r.gauss(0, 1e5) for _ in range(500)] + [float("-1e9"), 3.0, 3.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 250, 503):
        cut = kth_largest(df, k)
        assert sum(v >= cut for v in values) >= k and sum(v > cut + 1e-5 for v in values) <= k


def test_edges(spark, documents):
    none = spark.createDataFrame([], LABELS)
    rows = [(1, None, None, None), (2, "", "en", "s"), (2, "", "en", "s"), (None, "a b " * 100_000, None, None)]
    assert resampled(documents(rows, extra=True), none).count() == 4
    assert resampled(documents([]), none).count() == 0
    assert resampled(documents(rows), spark.createDataFrame([(2, 1, None), (None, 0, 0), (1, None, 0)], LABELS)).count() == 4
