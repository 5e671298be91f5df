"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, and its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is a small table of fewer files than there are cores.

    A single file may be a single row group, which one task would read and work on alone. A table of many files, or of a few
    very large ones (whose scan has many more parts than cores), is left as it is, so that a large corpus is never shuffled here. Both
    are decided by a number that the plan gives; no list of files is brought to Python.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores or len(df._jdf.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
