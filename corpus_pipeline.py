"""A corpus pipeline of five stages; each works on all documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import jaccard, mixing, packing, quality, secrets
from sylva.llm.common import Stages, arrow_rows


#: Documents that go to Python at a time: whole texts, up to very long ones, in bounded memory.
BATCH_DOCUMENTS = 500


def bounded(spark: SparkSession) -> None:
    """Stages that are called by themselves are written after their function returns, so that the session keeps the setting; :func:`run` puts it back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCUMENTS))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards those labelled good keeps."""
    bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resampled(docs, labels, with_keys=False)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    bounded(spark)
    return jaccard.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind."""
    bounded(spark)
    return secrets.without_secrets(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    bounded(spark)
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of tokens."""
    bounded(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: SQL has neither the tokenizer nor the language models; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each table is dropped once the next is written."""
    stages, before = Stages(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with arrow_rows(spark, BATCH_DOCUMENTS):
        for name, stage in STAGES:
            docs = stages.write(stage(spark, docs, sf_dir), name)
            if before:
                stages.drop(before)
            before = name
    return docs
