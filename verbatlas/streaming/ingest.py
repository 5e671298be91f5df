"""Incremental word counts over arriving documents: an extension of ours, by Structured Streaming.

Each micro-batch is counted on its own and appended under its number, so a batch that is tried again overwrites its own
files only. A reader sums the batches; `compacted` folds them into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.operators import corpus


def counting(documents: DataFrame, target: str, checkpoint: str):
    """Start counting a stream of documents (doc_id, text) into target; returns the running query."""

    def save(batch: DataFrame, number: int) -> None:
        corpus.word_counts(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, target: str) -> DataFrame:
    """slug, freq over all batches so far."""
    rows = spark.read.option("basePath", target).parquet(target)
    return rows.groupBy("slug").agg(F.sum("freq").alias("freq"))


def compacted(spark: SparkSession, target: str, into: str) -> None:
    counted(spark, target).write.mode("overwrite").parquet(f"{into}/batch=0")
