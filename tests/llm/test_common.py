from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sylva.llm import common


@pytest.mark.parametrize("n, most", [(50_000, 200), (300, 200), (100, 200), (0, 5)])
def test_sample_is_the_smallest_hashes(spark, n, most):
    rows = spark.range(n).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y"))
    want = sorted((r.h, r.x) for r in rows.select("x", F.xxhash64("x", F.lit(3)).alias("h")).collect())[:most]
    for distinct in (n, n + n // 20, n - n // 20):
        assert [r.x for r in common.hash_sample(rows, "x", most, distinct, 3).collect()] == [x for _, x in want]


def test_sample_sorts_few_rows(spark):
    rows = spark.range(200_000).withColumnRenamed("id", "x")
    filtered = common.hash_sample(rows, "x", 100, 200_000)
    assert len(filtered.collect()) == 100
    bound = (common.SORTED * 100 << 64) // 200_000 - (1 << 63)
    assert rows.filter(F.xxhash64("x") < bound).count() < 2 * common.SORTED * 100


def test_sample_with_a_hot_value(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("x"))
    assert common.hash_sample(rows, "x", 50, 20_001).count() == 50
