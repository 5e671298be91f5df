"""A stored token table in which single documents are replaced.

The table is partitioned by a bucket of the document's hash and holds a document in one row, its tokens as arrays by sentence; readers get a row a token.
Documents are replaced bucket by bucket: the rows of all other documents of the touched buckets and the new documents' are written aside first, then these buckets, and no others, are overwritten. What was
written aside stays under the batch's name: a batch that failed half-way, or is given again, is finished from there, and ends in the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions import text as X


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, any bucket, and the sentences in order: one row for each document that has any token. Whatever is no white space is part of one."""
    sentences = F.transform(X.sentences(F.col("text")), lambda s: F.struct(s["segment"].alias("segment"), X.surfaces(s["sentence"]).alias("surfaces")))
    return docs.filter(F.col("text").rlike(r"\S")).select("doc_id", sentences.alias("sentences"), *[c for c in docs.columns if c == "bucket"])


def _write(placed: DataFrame, path: str) -> None:
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """A few files a bucket; documents of a bucket are dealt by their ids, so a large one is several tasks' work."""
    lots = F.pmod(F.hash("doc_id"), F.lit(4))
    return docs.select("doc_id", "text", bucket(F.col("doc_id"), buckets).alias("bucket")).repartition("bucket", lots)


def create(docs: DataFrame, path: str, buckets: int) -> None:
    """The token table of all documents: texts are dealt to their buckets before they're cut, so no token is shuffled."""
    _write(_rows(_dealt(docs, buckets)), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, token_index, segment, sentence_no, surface."""
    of = lambda s, number: F.transform(s["surfaces"], lambda t: F.struct(s["segment"].alias("segment"), number.alias("sentence_no"), t.alias("surface")))
    rows = spark.read.parquet(path).select("doc_id", F.posexplode(F.flatten(F.transform("sentences", of))).alias("token_index", "t"))
    return rows.select("doc_id", "token_index", "t.segment", "t.sentence_no", "t.surface")


def replace(docs: DataFrame, path: str, buckets: int, batch: str) -> None:
    """Put the documents' tokens in the place of those that the table has of them; a document without tokens loses its rows.

    Ids aren't null. Only the touched buckets are read and written; whether the batch's ids are broadcast is Spark's choice.
    """
    spark = docs.sparkSession
    aside = f"{path}/_batch-{batch}"
    ids = docs.select("doc_id").distinct()
    touched = {r["bucket"] for r in ids.select(bucket(F.col("doc_id"), buckets).alias("bucket")).distinct().collect()}  # as many as there are buckets at most
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = spark.read.parquet(path).filter(F.col("bucket").isin(*touched)).join(ids, "doc_id", "left_anti")
    rows = kept.unionByName(_rows(_dealt(docs, buckets)))
    if not files.exists(of(f"{aside}/_SUCCESS")):
        # kept rows lie in their bucket's files already: they are dealt no more
        rows.write.mode("overwrite").partitionBy("bucket").parquet(aside)
    stored = spark.read.schema(rows.schema).parquet(aside)
    filled = {r["bucket"] for r in stored.select("bucket").distinct().collect()}
    _write(stored, path)
    for b in touched - filled:
        files.delete(of(f"{path}/bucket={b}"), True)
