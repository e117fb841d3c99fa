"""What several operators share: stage tables in the cluster's shared folder, words and spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators.staging import new_folder, shared_dir, staged

__all__ = ["Stages", "WORD", "WORDS", "arrow_rows", "exists", "hash_sample", "n_words", "join_each", "new_folder", "shared_dir", "staged"]

#: What the contracts call a word, in Java's, RE2's and Python's syntax alike.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Rows from which a key counts as hot, and the tasks that its rows are dealt to.
HOT, SALTS = 1_024, 16
#: How many times the rows of a sample are sorted to find it, about.
SORTED = 4


class Stages:
    """Stage tables of one operator, below one folder of the shared one. Those that nothing reads any more can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_folder(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`staged`; tables of one name are told apart."""
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        df.write.option("parquet.block.size", 32 << 20).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes all tables of these names."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in store.listStatus(path):
            if s.getPath().getName().partition("-")[2] in names:
                store.delete(s.getPath(), True)


def join_each(rows: DataFrame, each: DataFrame, key: str, by: str, stages: Stages, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``each``, which has a row per ``key`` and ``n``, how many of the rows have that key.

    Keys of over ``HOT`` rows are dealt to ``SALTS`` tasks by the column ``by``. Their list, a row for each ``HOT`` rows at
    most, is written first, so that its real size decides whether it is broadcast."""
    hot = stages.write(each.filter(F.col("n") > HOT).select(key, F.lit(True).alias("_hot")), "hot")
    rows = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    every = F.array(*[F.lit(i) for i in range(SALTS)])
    each = each.withColumn("_salt", F.explode(F.when(F.col("n") > HOT, every).otherwise(F.array(F.lit(0))))).drop("n")
    return rows.join(each, [key, "_salt"], how).drop("_salt")


def hash_sample(rows: DataFrame, by: str, most: int, distinct: int, seed: int | None = None) -> DataFrame:
    """The ``most`` rows of the smallest hashes of the column ``by``, ties by its value: the same in every run.

    ``by`` has ``distinct`` values, about. Only rows under a hash that some ``SORTED`` times as many values lie below are sorted,
    so that the one task that ends the sort gets that many, whatever the size of the table; that under ``most`` of them
    lie there doesn't happen, by chance or by an estimate that is a few percent off."""
    hashed = F.xxhash64(by) if seed is None else F.xxhash64(F.col(by), F.lit(seed))
    if SORTED * most < distinct:
        rows = rows.filter(hashed < F.lit((SORTED * most << 64) // distinct - (1 << 63)))
    return rows.orderBy(hashed, by).limit(most)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs within send Python so many rows at a time at most: long texts and sets fill a batch soon."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def n_words(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
