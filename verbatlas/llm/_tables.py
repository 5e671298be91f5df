"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset in local mode (tests) a folder of this process.

    A cluster must name one that its driver and executors share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"verbatlas-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where the tables written here are, as long as their DataFrames live.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts lineage at a file that outlives any executor, and gives the optimizer the true size of
    what follows, so that joins are broadcast only where the measured bytes allow it. The files
    go when they are discarded or the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verbatlas-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    files, written = _files(spark, path)
    files.deleteOnExit(written)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote, once nothing that is still to be run reads them."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            files, at = _files(table.sparkSession, path)
            files.delete(at, True)


def give_back() -> None:
    """Hand free memory of this process back to the system: what a fit on a sample used for a moment stays with the allocators else."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def carried(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (a struct of the columns in keep, but for the text) and text, which so travels to Python once."""
    return docs.select(F.struct(F.lit(0).alias("n"), *[docs[c].alias(f"c{i}") for i, c in enumerate(keep) if c != "text"]).alias("row"), docs["text"].alias("text"))


def restored(keep: list[str]) -> list[Column]:
    """The columns in keep, from what `carried` made of them."""
    return [F.col("text") if c == "text" else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(keep)]


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
