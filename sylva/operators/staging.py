"""Stage tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session has none, a folder below the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sylva/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage and reads it again: computed once, safe from lost executors, and of
    known size, by which the optimizer decides whether it is broadcast. The folder is the session's to clear."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    # Smaller row groups than by default: each open file of a task holds one in memory.
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
